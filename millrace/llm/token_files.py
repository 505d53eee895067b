"""Token-id files: independent zstandard frames, one a document, with a trailing seek table and a checksum per frame.

Layout, after the public zstd seekable format: the documents' frames (ids as little-endian unsigned 32-bit integers) in
ascending order of doc_id, a skippable frame with the doc_ids, and a skippable frame with the seek table: compressed
size, decompressed size and the low 32 bits of XXH64 of the content of each frame, then the footer. A reader finds a
document by the id list and the table, and decompresses nothing else.

Files are written under a name of their own and moved into place, so a task that runs twice leaves one whole file; the
manifest names the files of tasks that ended well.

Defined cases: a null text is empty and gives the end id alone. Null doc_ids come first. Rows that repeat a doc_id stand
side by side in the order of a hash of the text, then of the text; `read` returns each. Extra columns aren't written.
Very long texts are one frame each, held whole by writer and reader. An empty table gives no files, an empty manifest
and an empty result.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import tokenize
from millrace.llm.common import materialize, shared_dir, table

# Fixed values of the seekable format, and the skippable magic used for the id list.
SEEK_MAGIC, SEEK_FOOTER, IDS_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50, 0x80
NULL_ID = -(1 << 63)
BATCH = 1 << 23  # bytes of ids that `read` hands on at once, or one document
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long, first_id long, last_id long"


class Writer:
    """Frames to one file; close() adds the id list and the seek table."""

    def __init__(self, url: str, level: int = 3):
        self.url = url
        self.fs, self.path = pa.fs.FileSystem.from_uri(url)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.own)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.table, self.ids, self.n_tokens = bytearray(), bytearray(), 0

    def add(self, doc_id: int | None, packed: bytes) -> None:
        frame = self.zstd.compress(packed)
        self.out.write(frame)
        self.table += struct.pack("<III", len(frame), len(packed), xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF)
        self.ids += struct.pack("<q", NULL_ID if doc_id is None else doc_id)
        self.n_tokens += len(packed) // 4

    def close(self) -> int:
        ids = self.zstd.compress(bytes(self.ids))
        self.out.write(struct.pack("<II", IDS_MAGIC, len(ids)) + ids)
        self.table += struct.pack("<III", len(ids) + 8, 0, 0)
        n = len(self.table) // 12
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(self.table) + 9) + bytes(self.table) + struct.pack("<IBI", n, CHECKSUMS, SEEK_FOOTER))
        self.out.close()
        size = self.fs.get_file_info(self.own).size
        self.fs.move(self.own, self.path)
        return size


class Reader:
    """Random access to one file."""

    def __init__(self, url: str):
        fs, path = pa.fs.FileSystem.from_uri(url)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_FOOTER or flags != CHECKSUMS:
            raise ValueError(f"{url}: no seek table")
        self.table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        ids = self.file.read_at(int(self.table[-1, 0]), int(self.starts[n - 1]))
        self.zstd = zstandard.ZstdDecompressor()
        self.ids = np.frombuffer(self.zstd.decompress(ids[8:]), "<i8")

    def frame(self, k: int) -> bytes:
        """Content of the k-th document, checked."""
        size, length, checksum = (int(x) for x in self.table[k])
        packed = self.zstd.decompress(self.file.read_at(size, int(self.starts[k])), max_output_size=length) if length else b""
        if xxhash.xxh64_intdigest(packed) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k}: wrong checksum")
        return packed

    def find(self, doc_id: int | None) -> range:
        """Places of the documents with this id."""
        key = NULL_ID if doc_id is None else doc_id
        return range(int(np.searchsorted(self.ids, key)), int(np.searchsorted(self.ids, key, "right")))


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """Writes the files and returns their manifest, in ascending doc_id order by `part`."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, first, last, n = TaskContext.get().partitionId(), None, None, None, 0
        encoder = tokenize.load(tokenizer)
        for b in batches:
            for rows in encoder.encoded(b.column(0), b.column(1)):
                for i, packed in rows:
                    if out is None:
                        out, first = Writer(f"{folder}/part-{part:06d}.tok.zst", level), i
                    out.add(i, packed + end)
                    last, n = i, n + 1
        if out is not None:
            row = {"part": part, "path": out.url, "n_docs": n, "n_tokens": out.n_tokens, "n_bytes": out.close(), "first_id": first, "last_id": last}
            types = [("part", pa.int32()), ("path", pa.string()), *((k, pa.int64()) for k in list(row)[2:])]
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema(types))

    return materialize(dealt.mapInArrow(run, MANIFEST), "manifest")


def _each(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`, the ids in files before, dealt out a file a task. The number is given: Spark would make one task of so small a table."""
    base = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(manifest.withColumn("base", base), "bases")
    return bases.repartition(max(1, bases.count()))


def read(manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (packed) of all documents, or of a given list of ids by seeking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                file = Reader(row["path"])
                starts = row["base"] + np.concatenate([[0], np.cumsum(file.table[:-1, 1] // 4, dtype=np.int64)])
                wanted = range(len(file.ids)) if doc_ids is None else [k for i in doc_ids for k in file.find(i)]
                ends = np.cumsum([int(file.table[k, 1]) for k in wanted]) // BATCH  # a batch of BATCH bytes, or of one document
                for lo, hi in itertools.pairwise([0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(wanted)]) if len(wanted) else ():
                    ks = wanted[lo:hi]
                    ids = [None if file.ids[k] == NULL_ID else int(file.ids[k]) for k in ks]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([int(starts[k]) for k in ks], pa.int64()), pa.array([file.frame(k) for k in ks], pa.binary())], ["doc_id", "start", "ids"])

    return _each(manifest).mapInArrow(run, "doc_id long, start long, ids binary")


def digest(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([zlib.crc32(p) for p in packed], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    manifest = write(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), 0, shared_dir(spark, "tokens"))
    return digest(manifest)
