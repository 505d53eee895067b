"""Best-fit packing with swap-based local search.

A piece of `capacity` tokens is a sequence of its own. The others are dealt into groups by a hash, as many as their number
asks for. In each group best-fit decreasing gives the first
bins; then the emptiest bin is taken apart: its pieces move to bins with room, or one piece or any two are exchanged
against a smaller one of another bin. Every step increases the sum of squared fill. The search ends when the bins meet
the lower bound or no bin has a step left. The emptiest bin of each group then meets those of other groups in a second
round.

Defined cases: a null text is empty and gives the end id alone. A null doc_id is packed like any other and stays null.
Rows that repeat a doc_id, or all of another row, are packed each. Very long texts are cut into pieces of the capacity.
Extra columns of docs aren't carried; an empty table gives an empty result. Ties go by doc_id, then piece.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import tokenize
from millrace.llm.common import materialize, small_batches, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
GROUP = 16_384  # pieces a group, in the mean
MEET = 256  # groups whose emptiest bins meet


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Bin of each piece by best-fit decreasing, and the room left in each bin. Bins are found by a bitmap of rooms."""
    order = np.argsort(-lengths, kind="stable")
    bin_of = np.empty(len(lengths), np.int64)
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r tokens of room
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = at[r].pop()
            if not at[r]:
                rooms &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(0)
        bin_of[i], room[b] = b, r - size
        if room[b]:
            at[r - size].append(b)
            rooms |= 1 << (r - size)
    return bin_of, room


def improve(lengths: np.ndarray, bin_of: np.ndarray, room: np.ndarray, capacity: int, steps: int | None = None) -> None:
    """Local search in place, to its end or for so many steps; a bin that is emptied keeps the whole capacity as room."""
    least = -(-int(lengths.sum()) // capacity)
    used = int((room < capacity).sum())
    left = math.inf if steps is None else steps
    if used <= least:
        return
    search = _Search(lengths, bin_of, room, capacity)
    free, moved = np.ones(len(room), bool), False  # bins not tried since the last turn, and whether a step was made in it
    while used > least and left > 0:
        open_room = np.where(free & (room < capacity), room, 0)
        donor = int(np.argmax(open_room))
        if not open_room[donor]:
            if not moved:
                return
            free[:], moved = True, False
            continue
        n = search.take_apart(donor, left)
        left, moved = left - n, moved or n > 0
        free[donor] = False
        if room[donor] == capacity:
            used -= 1


class _Search:
    """Pieces by size and bins by room, so that a step looks at sizes and rooms and not at pieces."""

    def __init__(self, lengths: np.ndarray, bin_of: np.ndarray, room: np.ndarray, capacity: int):
        self.bin_of, self.room, self.capacity = bin_of, room, capacity
        self.order = np.argsort(lengths, kind="stable")  # below, a piece is its place in this order
        self.size = lengths[self.order]
        self.sizes, self.starts = np.unique(self.size, return_index=True)
        self.space = room[bin_of[self.order]]  # room of each piece's bin
        self.members: list[set[int]] = [set() for _ in range(len(room))]
        for at, b in enumerate(bin_of[self.order].tolist()):
            self.members[b].add(at)
        self.at: list[set[int]] = [set() for _ in range(capacity + 1)]  # bins by room
        self.count = np.zeros(capacity + 1, np.int64)
        for b, r in enumerate(room.tolist()):
            self._list(b, r)

    def _list(self, b: int, r: int) -> None:
        if 0 < r < self.capacity:
            self.at[r].add(b)
            self.count[r] += 1

    def _unlist(self, b: int, r: int) -> None:
        if 0 < r < self.capacity:
            self.at[r].discard(b)
            self.count[r] -= 1

    def take_apart(self, donor: int, most: float) -> int:
        """Steps from the donor until it is empty or no step is left, `most` at most; how many they were."""
        self._unlist(donor, int(self.room[donor]))
        n = 0
        while n < most and self.members[donor]:
            own = np.array(sorted(self.members[donor]))
            self.space[own] = 0  # a donor takes nothing from itself
            step = self._step(int(self.room[donor]), own)
            if step is None:
                break
            self._apply(donor, *step)
            n += 1
        self.space[list(self.members[donor])] = self.room[donor]
        self._list(donor, int(self.room[donor]))
        return n

    def _apply(self, donor: int, give: list[int], take: list[int], other: int) -> None:
        delta = int(self.size[give].sum() - self.size[take].sum())
        self._unlist(other, int(self.room[other]))
        self.members[donor].difference_update(give)
        self.members[donor].update(take)
        self.members[other].difference_update(take)
        self.members[other].update(give)
        self.bin_of[self.order[give]] = other
        self.bin_of[self.order[take]] = donor
        self.room[other] -= delta
        self.room[donor] += delta
        self.space[list(self.members[other])] = self.room[other]
        self._list(other, int(self.room[other]))

    def _step(self, room: int, own: np.ndarray) -> tuple[list[int], list[int], int] | None:
        """A move, else an exchange of one, else of any two, that adds to the squared fill: (pieces given, pieces taken, other bin)."""
        sizes, first, n = np.unique(self.size[own], return_index=True, return_counts=True)
        rooms = np.flatnonzero(self.count)
        if not len(rooms):
            return None
        k = np.searchsorted(rooms, sizes)  # a move, to the fullest bin with room
        to = rooms[np.minimum(k, len(rooms) - 1)]
        gain = np.where(k < len(rooms), sizes * (sizes + room - to), 0)
        x = int(np.argmax(gain))
        if gain[x] > 0:
            return [int(own[first[x]])], [], min(self.at[int(to[x])])
        near = np.where(self.space <= room, self.space, 0)
        most = np.maximum.reduceat(near, self.starts)  # largest room with a piece of each size, of bins no emptier than the donor
        reach = np.maximum.accumulate(self.sizes + most)
        far = np.flatnonzero(self.space > room)
        found = self._exchange(sizes, room, near, most, reach, far)
        if found is not None:
            x, take = found
            return [int(own[first[x]])], [take], int(self.bin_of[self.order[take]])
        i, j = np.triu_indices(len(sizes))
        both = (i < j) | (n[i] > 1)
        i, j = i[both], j[both]
        found = self._exchange(sizes[i] + sizes[j], room, near, most, reach, far)
        if found is not None:
            x, take = found
            return [int(own[first[i[x]]]), int(own[first[j[x]] + (i[x] == j[x])])], [take], int(self.bin_of[self.order[take]])
        return None

    def _exchange(self, totals: np.ndarray, room: int, near: np.ndarray, most: np.ndarray, reach: np.ndarray, far: np.ndarray) -> tuple[int, int] | None:
        """Which total goes for which piece. For a total the smallest piece in reach of a bin's room leaves the most to it."""
        if not len(totals):
            return None
        k = np.searchsorted(reach, totals)
        kept = np.minimum(k, len(reach) - 1)
        d = totals - self.sizes[kept]
        gain = np.where((k < len(reach)) & (d > 0), d * (d + room - most[kept]), 0)
        x = int(np.argmax(gain))
        if gain[x] > 0:
            lo = int(self.starts[k[x]])
            rooms = near[lo : self.starts[k[x] + 1] if k[x] + 1 < len(self.starts) else None]
            return x, lo + int(np.argmin(np.where(rooms >= d[x], rooms, self.capacity + 1)))
        if len(far):  # of emptier bins: what goes there must leave less room than the donor has
            level = self.size[far] + self.space[far]
            flags = np.zeros(2 * self.capacity + 1, bool)
            flags[level] = True
            levels = np.flatnonzero(flags)
            k = np.searchsorted(levels, totals)
            lead = np.where(k < len(levels), totals + room - levels[np.minimum(k, len(levels) - 1)], 0)
            x = int(np.argmax(lead))
            if lead[x] > 0:
                return x, int(far[np.argmax(level == levels[k[x]])])
        return None


def pack(lengths: np.ndarray, capacity: int, steps: int | None = None) -> np.ndarray:
    """Bin of each piece, numbered without gaps."""
    bin_of, room = best_fit(lengths, capacity)
    improve(lengths, bin_of, room := np.array(room, np.int64), capacity, steps)
    return np.unique(bin_of, return_inverse=True)[1].reshape(-1)


def pack_pieces(pieces: DataFrame, n_pieces: int, capacity: int = 4096, steps: int | None = None) -> DataFrame:
    """pieces (a table that is written, as the row's place in it helps to deal it) with sequence_id and offset. n_pieces, of those that aren't full, sets the number of groups; sequence_id of full ones is negative."""
    groups = max(1, -(-n_pieces // GROUP))
    place = F.monotonically_increasing_id()
    full = pieces.withColumns({"sequence_id": -1 - place, "offset": F.lit(0).cast("long")}).where(F.col("length") >= capacity)

    def run(level: int):
        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
            lengths = pdf["length"].to_numpy(np.int64)
            bins = pack(lengths, capacity, steps)
            fill = np.bincount(bins, lengths)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order])
            firsts = np.concatenate([[0], np.cumsum(fill.astype(np.int64))[:-1]])
            offset = np.empty(len(pdf), np.int64)
            offset[order] = ends - lengths[order] - firsts[bins[order]]
            g = int(pdf["grp"].iloc[0])
            pdf["sequence_id"] = bins + (((level << 30) + g) << 32)
            pdf["offset"] = offset
            pdf["loose"] = bins == int(np.argmin(fill))
            return pdf

        return packed

    schema = PIECES + ", grp long, sequence_id long, offset long, loose boolean"
    # With the row's place rows that are the same in all columns spread over the groups, too.
    grouped = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", place), F.lit(groups))).where(F.col("length") < capacity)
    first = grouped.groupBy("grp").applyInPandas(run(0), schema)
    if groups == 1:
        return full.unionByName(first.drop("grp", "loose"))
    first = materialize(first, "packed")
    loose = first.where("loose").select(*(c.split()[0] for c in PIECES.split(", ")), (F.col("grp") / MEET).cast("long").alias("grp"))
    second = loose.groupBy("grp").applyInPandas(run(1), schema)
    return full.unionByName(first.where("not loose").unionByName(second).drop("grp", "loose"))


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of each document's ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (packed)."""
    end = struct.pack("<I", end_id)
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenize.load(tokenizer)
        for b in batches:
            for encoded in encoder.encoded(b.column(0), b.column(1)):
                rows: list[tuple] = []
                for i, packed in encoded:
                    packed += end
                    for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                        ids = packed[at : at + 4 * capacity]
                        rows.append((i, k, at // 4, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """The packing of docs: a row a piece, with its place and the checksum of its ids."""
    with small_batches(docs.sparkSession):
        pieces = materialize(cut(docs, tokenizer, end_id, capacity, with_ids=False), "pieces")
    return pack_pieces(pieces, pieces.where(F.col("length") < capacity).count(), capacity)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """sequence_id and ids (packed) of every sequence of a packing: at most `capacity` ids each. Needs distinct doc_ids."""
    at = packed.select("doc_id", "piece", "sequence_id", "offset")
    rows = cut(docs, tokenizer, end_id, capacity).select("doc_id", "piece", "ids").join(at, ["doc_id", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return plan(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), 1)
