"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

`sufficient_lookahead` derives from the merge list how many bytes after a token can still change it. MergeTransducer
holds bytes back only until that many follow, so its memory doesn't grow with the text; StreamEncoder splits text into
pieces with the same guarantee (special tokens, words, runs of white space). A boundary between pieces settles all bytes
before it. All ids come from the transducer: pieces that lie whole in a block by its transitions, which are computed when
they first occur, and the piece that a block leaves open byte by byte. Results equal the tokenizers library's on the
whole text.

Defined cases: a null text is empty and has no tokens. Very long texts, and texts without any boundary, pass in blocks.
Rows keep their order, repeated rows and extra columns their values; columns named like the operator's own are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

# The white space, letters and numbers of the first 256 code points.
WHITE, LETTERS, NUMBERS = "\\t-\\r \\x85\\xa0", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
#: The byte-level split: contractions, then runs of letters, numbers or other signs after at most one space, then white space.
SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
BEYOND_LATIN = re.compile("[^\x00-\xff]")
KINDS = [f"[{LETTERS}]+", f"[{NUMBERS}]+", f"[^{WHITE}{LETTERS}{NUMBERS}]+", f"[{WHITE}]+"]
WORDS, RUNS = [re.compile(" ?" + k) for k in KINDS], [re.compile(k) for k in KINDS]
BLOCK = 1 << 14  # characters that are split at once
HOLD = 3  # characters after a piece that settle where it ends


class StandIns(dict):
    """For str.translate: a character of the same kind among the first 256 for each one beyond.

    Unicode versions differ in what is a letter or a number, so the library's own splitter is asked, once a character."""

    def __missing__(self, point: int) -> int:
        from tokenizers.pre_tokenizers import ByteLevel

        if point > 255:
            splits = lambda text: len(ByteLevel(add_prefix_space=False).pre_tokenize_str(text)) > 1
            self[point] = next((ord(s) for before, s in (("a", "ª"), ("1", "²"), ("!", "¡")) if not splits(before + chr(point))), 0x85)
        else:
            self[point] = point
        return self[point]


STAND_INS = StandIns()


def latin(text: str) -> str:
    return text.translate(STAND_INS) if BEYOND_LATIN.search(text) else text


def pieces(text: str) -> list[str]:
    if not BEYOND_LATIN.search(text):
        return SPLIT.findall(text)
    at, out = 0, []
    for p in SPLIT.findall(latin(text)):
        out.append(text[at : at + len(p)])
        at += len(p)
    return out


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A byte-level vocabulary and its merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda token: bytes(letter[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.single = [0] * 256
        for c, b in letter.items():
            self.single[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.lookahead = sufficient_lookahead(self)

    def encode(self, data: bytes) -> list[int]:
        """Ids of a whole piece: the pair of least rank merges first, the leftmost of equals."""
        ids, pairs = [self.single[b] for b in data], self.pairs
        if len(ids) > 64:
            return self._encode_long(ids)
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                p = pairs.get((ids[i], ids[i + 1]))
                if p is not None and (best is None or p[0] < best[0]):
                    best, at = p, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := pairs.get((ids[i], ids[k])):
                    heapq.heappush(heap, (p[0], i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (p := pairs.get((ids[h], ids[i]))):
                heapq.heappush(heap, (p[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]


def sufficient_lookahead(m: Merges) -> int:
    """Bytes after a token that decide whether it stands, at most.

    A token t is lost to its right only if a merge (x, w) of t's right spine (t, its right part, that part's right part
    ...) fires before x itself is used in t. That merge needs w to stand to its right up to the merge's own rank, which
    merges of smaller rank decide. So reach(merge) = len(w) + the largest reach of an earlier merge on w's spine, and
    ranks fall along the chain; the merges are taken by rank, each chain once."""
    made: dict[int, list[tuple[int, int]]] = {}  # id -> (rank, right part) of the merges that make it
    for (_, b), (rank, c) in m.pairs.items():
        made.setdefault(c, []).append((rank, b))
    ranks: dict[int, list[int]] = {}
    reach: dict[int, list[int]] = {}  # of merges with this left part, by rank: the largest so far

    def spine(token: int, rank: int) -> int:
        most, todo = 0, [(token, rank)]
        while todo:
            token, rank = todo.pop()
            if token in ranks and (k := bisect.bisect_left(ranks[token], rank)):
                most = max(most, reach[token][k - 1])
            todo += [(right, min(rank, used)) for used, right in made.get(token, ())]
        return most

    for (a, b), (rank, _) in sorted(m.pairs.items(), key=lambda x: x[1][0]):
        r = len(m.bytes_of[b]) + spine(b, rank)
        ranks.setdefault(a, []).append(rank)
        reach.setdefault(a, []).append(max(r, reach[a][-1] if reach.get(a) else 0))
    return max((spine(t, len(m.pairs) + 1) for t in m.bytes_of), default=0)


class MergeTransducer:
    """Bytes of one piece in, ids out as soon as they are stable."""

    def __init__(self, merges: Merges):
        self.merges, self.pending = merges, b""
        self.room = 4 * merges.lookahead + 1024

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.room):
            self.pending += data[i : i + self.room]
            if len(self.pending) >= self.room:
                end, stable = 0, []
                for t in self.merges.encode(self.pending):
                    if end + len(self.merges.bytes_of[t]) + self.merges.lookahead > len(self.pending):
                        break
                    end += len(self.merges.bytes_of[t])
                    stable.append(t)
                out += stable
                self.pending = self.pending[end:]
        return out

    def finish(self) -> list[int]:
        out, self.pending = self.merges.encode(self.pending), b""
        return out


class Transitions(dict):
    """Packed ids by whole piece: what the transducer emits from its empty state for the piece and the boundary after it.

    Each is computed by the transducer when it first occurs, as a lazily built automaton has its transitions; emptied when full, so bounded."""

    LIMIT, LONGEST = 300_000, 48

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        transducer = MergeTransducer(self.merges)
        packed = pack(transducer.feed(piece.encode()) + transducer.finish())
        if len(piece) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = packed
        return packed


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class StreamEncoder:
    """Text in by feed(), little-endian unsigned 32-bit ids out as soon as they are stable; finish() gives the rest.

    Holds a block of text, a few characters that wait for what follows and, for a piece that a block leaves open, the transducer's lookahead."""

    def __init__(self, merges: Merges, transitions: Transitions | None = None, block: int = BLOCK):
        self.merges, self.transitions, self.block = merges, transitions if transitions is not None else Transitions(merges), block
        self.special = re.compile("|".join(re.escape(s) for s in sorted(merges.special, key=len, reverse=True))) if merges.special else None
        self.longest = max(map(len, merges.special), default=1)
        self.raw = self.held = ""
        self.run: tuple[int, MergeTransducer] | None = None  # kind of the open piece, and its state

    def feed(self, text: str) -> bytes:
        return b"".join(self.stream(text))

    def stream(self, text: str) -> Iterator[bytes]:
        for i in range(0, len(text), self.block):
            self.raw += text[i : i + self.block]
            yield self._specials()
            keep = self.longest - 1
            if len(self.raw) > keep:
                ready, self.raw = self.raw[: len(self.raw) - keep], self.raw[len(self.raw) - keep :]
                yield self._text(ready, False)

    def finish(self) -> bytes:
        out = self._specials() + self._text(self.raw, True)
        self.raw = ""
        return out

    def _specials(self) -> bytes:
        out = []
        while self.special and (m := self.special.search(self.raw)):
            out.append(self._text(self.raw[: m.start()], True) + struct.pack("<I", self.merges.special[m[0]]))
            self.raw = self.raw[m.end() :]
        return b"".join(out)

    def _text(self, text: str, last: bool) -> bytes:
        """Ids of the pieces that text settles; last: a special token or the end follows."""
        text, self.held, out = self.held + text, "", []
        if self.run:
            kind, transducer = self.run
            m = RUNS[kind].match(latin(text))
            end = m.end() if m else 0
            if kind == 3 and end and (end < len(text) or not last):
                end -= 1  # the last space may belong to the next word
            out.append(pack(transducer.feed(text[:end].encode())))
            text = text[end:]
            open_still = not last and (not text or kind == 3 and RUNS[3].fullmatch(latin(text)))
            if open_still:
                self.held = text
                return b"".join(out)
            out.append(pack(transducer.finish()))
            self.run = None
        found = pieces(text)
        if not last:
            held = 0
            while found and held < HOLD:
                held += len(found.pop())
            if held:
                self.held = text[len(text) - held :]
        out.append(b"".join(map(self.transitions.__getitem__, found)))
        if len(self.held) > HOLD:  # the last piece goes on in the next block, or ends with this one: its bytes enter the transducer now
            kind = next((k for k, r in enumerate(WORDS) if r.fullmatch(latin(self.held))), None)
            if kind is not None:
                self.run = (kind, MergeTransducer(self.merges))
                keep = 1 if kind == 3 else 0
                body, self.held = self.held[: len(self.held) - keep], self.held[len(self.held) - keep :]
                out.append(pack(self.run[1].feed(body.encode())))
        return b"".join(out)


class StreamDecoder:
    """Ids in by feed(), text out: a byte-to-text state machine that holds back an unfinished character, and replaces what can't become one."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


_LOADED: dict[str, tuple[Merges, Transitions]] = {}


def load(path: str) -> tuple[Merges, Transitions]:
    """The vocabulary at path and its transitions, once a Python worker."""
    if path not in _LOADED:
        merges = Merges(path)
        _LOADED[path] = merges, Transitions(merges)
    return _LOADED[path]


def encoded(text: str, merges: Merges, transitions: Transitions, block: int = BLOCK) -> Iterator[bytes]:
    """Packed ids of the text, block by block."""
    encoder = StreamEncoder(merges, transitions, block)
    yield from encoder.stream(text)
    yield encoder.finish()


def decoded(blocks: Iterator[bytes], merges: Merges) -> Iterator[str]:
    """Text of packed ids, block by block."""
    decoder = StreamDecoder(merges)
    for packed in blocks:
        yield decoder.feed(memoryview(packed).cast("I"))
    yield decoder.finish()


def encode(text: str, merges: Merges, transitions: Transitions) -> bytes:
    return b"".join(encoded(text, merges, transitions))


def decode(packed: bytes, merges: Merges) -> str:
    return "".join(decoded((packed[i : i + 4 * BLOCK] for i in range(0, len(packed), 4 * BLOCK)), merges))


def digests(text: str, merges: Merges, transitions: Transitions) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the ids and of the text that they decode to: both streams pass block by block, and neither is held."""
    n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), StreamDecoder(merges)
    for packed in encoded(text, merges, transitions):
        n += len(packed) // 4
        ids_hash.update(packed)
        text_hash.update(decoder.feed(memoryview(packed).cast("I")).encode())
    text_hash.update(decoder.finish().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs with `ids`, an array of ints."""
    schema = docs.drop("ids").withColumn("ids", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, transitions = load(vocabulary)
        for b in batches:
            ids = [list(memoryview(encode(t.as_py() or "", merges, transitions)).cast("I")) for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-1]), pa.array(ids, pa.list_(pa.int32()))], schema.names)

    return docs.drop("ids").mapInArrow(run, schema)


def bpe_decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """tokens with `decoded`, the text of the ids; null ids give an empty text."""
    schema = tokens.drop("decoded").withColumn("decoded", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = load(vocabulary)
        for b in batches:
            texts = []
            for ids in b.column(ids_col):
                machine = StreamDecoder(merges)
                texts.append(machine.feed(ids.as_py() or []) + machine.finish())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-1]), pa.array(texts, pa.string())], schema.names)

    return tokens.drop("decoded").mapInArrow(run, schema)


def round_trip_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document: encoded and decoded in one pass, a document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, transitions = load(vocabulary)
        for b in batches:
            rows = [digests(t.as_py() or "", merges, transitions) for t in b.column(1)]
            n, ids_hash, text_hash = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return round_trip_digest(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
