"""Blocked counting Bloom filter with two bit planes, built on executors and merged by block.

A cell saturates at two, so a key is possibly repeated where all its cells are at two; no repeated key is missed. Size
is bounded by MAX_CELLS whatever the input: beyond it more keys pass as possibly repeated, which costs shuffle, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 12  # cells in a block: 4,096
MAX_CELLS = 1 << 30  # 128 MiB as a bitmap: the bound of what is broadcast
HASHES = 4


def cells_for(n: int, per_key: int = 16) -> int:
    """Cells for n keys, in whole blocks: one block at least, MAX_CELLS at most. Not rounded further, so the share of false hits is the same at every size."""
    return min(MAX_CELLS, -(-max(1, n) * per_key >> BLOCK_BITS) << BLOCK_BITS)


def positions(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and its HASHES cells in the block (one row a hash)."""
    k = keys.astype(np.int64).view(np.uint64)
    block = (k >> np.uint64(64 - 30)) % np.uint64(cells >> BLOCK_BITS)
    with np.errstate(over="ignore"):
        h = k * np.uint64(0x9E3779B97F4A7C15)
    return block.astype(np.int32), np.stack([(h >> np.uint64(BLOCK_BITS * i)) & np.uint64((1 << BLOCK_BITS) - 1) for i in range(HASHES)]).astype(np.int64)


def _capped(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Each distinct key of a batch with its count, two at most: a hot key sends one row a batch."""
    for b in batches:
        keys, counts = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        block, _ = positions(keys, cells)
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(keys), pa.array(np.minimum(counts, 2).astype(np.int32))], ["block", "key", "n"])


def _planes(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Bitmap of the cells at two, for each block of the task; rows come sorted by block, so one block is held at a time."""
    current, counts = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())], ["block", "bits"])

    for b in batches:
        block, keys, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(block):
            continue
        _, at = positions(keys, cells)
        cuts = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if block[lo] != current:
                if current is not None:
                    yield out()
                current, counts = int(block[lo]), np.zeros(1 << BLOCK_BITS, np.int64)
            counts += np.bincount(at[:, lo:hi].ravel(), np.tile(n[lo:hi], HASHES), 1 << BLOCK_BITS).astype(np.int64)
    if current is not None:
        yield out()


class Filter:
    """The merged bitmap; maybe(keys) is a boolean array."""

    def __init__(self, cells: int, bits: np.ndarray):
        self.cells, self.bits = cells, bits

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        block, at = positions(keys, self.cells)
        cell = (block.astype(np.int64) << BLOCK_BITS) + at
        return ((self.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).all(axis=0)


def repeated_filter(keys: DataFrame, n: int, per_key: int = 16) -> Filter:
    """Filter of the keys (one long column, no nulls) that may occur twice or more; n rows are expected."""
    cells = cells_for(n, per_key)
    capped = keys.mapInArrow(lambda it: _capped(it, cells), "block int, key long, n int")
    dealt = capped.repartition("block").sortWithinPartitions("block")
    rows = dealt.mapInArrow(lambda it: _planes(it, cells), "block int, bits binary").where(F.col("bits").isNotNull())
    bits = np.zeros(cells >> 3, np.uint8)
    step = 1 << (BLOCK_BITS - 3)
    for batch in rows.toArrow().to_batches():  # cells / 4,096 rows of 512 bytes: bounded by MAX_CELLS
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            bits[block * step : (block + 1) * step] = np.frombuffer(data.as_buffer(), np.uint8)
    return Filter(cells, bits)
