"""A count-min sketch of hash values over all rows, merged from partition sketches, as bit planes of fixed size.

Plane t of a sketch row has a bit for each cell that at least `levels[t]` values fell into. A value's estimate reaches a level
if its cells do so in every row, so estimates are never too low. The planes' size is a parameter and does not grow with the
data: with more data than cells the estimates grow coarser, never wrong in that direction, so a broadcast of them is bounded.

Partition sketches travel as lists of cells by block of 2**16 cells (two bytes a value), each cell at most as often as the top
level asks, so a value that fills a third of the data costs no more than a rare one.

Where a sketch has fewer cells than there are values, repeated() tells exactly which of some values occur more than once: they are
dealt by hash, so that no task holds more than a slice of them, and only those found come back, as a Bloom filter of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from envatlas.llm.arrowtext import mix
from envatlas.llm.shared import tidy

_BLOCK = 16
#: Values that a task holds before it sends their cells on.
_HELD = 2 << 20
#: Slices of repeated(), as a power of two, and the multipliers that name a value's bits in its slice of the filter.
_SLICES = 10
_ODD = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def cells_of(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each value in a row of 2**bits cells; rows are independent."""
    return (mix(values, 100 + row) >> np.uint64(64 - bits)).astype(np.uint32)


def _packed(values: np.ndarray, rows: int, bits: int, top: int) -> tuple[list, list]:
    """(block, cells as bytes): a block's number holds its row."""
    blocks, blobs = [], []
    for row in range(rows):
        c = np.sort(cells_of(values, row, bits))
        if len(c) > top:
            keep = np.ones(len(c), dtype=bool)
            keep[top:] = c[top:] != c[:-top]
            c = c[keep]
        high = c >> np.uint32(_BLOCK)
        at = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(c) else []
        low = c.astype(np.uint16)
        for a, b in zip(at, [*at[1:], len(c)], strict=True):
            blocks.append((row << (bits - _BLOCK)) | int(high[a]))
            blobs.append(low[a:b].tobytes())
    return blocks, blobs


def sketch(df: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, rows: int, levels: list[int]) -> Broadcast:
    """Planes [row, level, bytes] of the 64-bit `values` of all batches of `df`, broadcast: rows * levels * 2**(bits - 3) bytes."""
    top = max(levels)
    bits = max(bits, _BLOCK)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            blocks, blobs = _packed(np.concatenate(held), rows, bits, top)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(blocks, type=pa.int32()), pa.array(blobs, type=pa.binary())], names=["block", "cells"])

        for batch in batches:
            for v in values(batch):
                held.append(v)
                n += len(v)
                if n >= _HELD:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks arrive one after the other, so that one block's counts are held at a time; its cells are counted together, a few million at once."""
        types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        now, seen, held, n = None, np.zeros(1 << _BLOCK, dtype=np.int64), [], 0

        def count() -> None:
            seen[:] += np.bincount(np.frombuffer(b"".join(held), dtype=np.uint16), minlength=1 << _BLOCK)
            held.clear()

        def done() -> pa.RecordBatch:
            count()
            out: list[list] = [[], [], [], []]
            for t, level in enumerate(levels):
                hit = np.flatnonzero(seen >= level)
                if len(hit):
                    sparse = len(hit) < 1 << (_BLOCK - 4)
                    bits_ = hit.astype(np.uint16).tobytes() if sparse else np.packbits(seen >= level, bitorder="little").tobytes()
                    for column, x in zip(out, (now, t, sparse, bits_), strict=True):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, types, strict=True)], names=["block", "level", "sparse", "bits"])

        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, n = block, 0
                    seen[:] = 0
                held.append(cells)
                n += len(cells)
                if n >= _HELD:
                    count()
                    n = 0
        if now is not None:
            yield done()

    planes = np.zeros((rows, len(levels), 1 << (bits - 3)), dtype=np.uint8)
    span = 1 << (_BLOCK - 3)
    merged = df.mapInArrow(tidy(partial), "block int, cells binary").repartition("block").sortWithinPartitions("block").mapInArrow(tidy(merge), "block int, level int, sparse boolean, bits binary")
    # the planes' size is bounded: few parts mean few fetches
    for r in merged.repartition(8).toLocalIterator():
        row, block = r.block >> (bits - _BLOCK), r.block & ((1 << (bits - _BLOCK)) - 1)
        own = planes[row, r.level, block * span : (block + 1) * span]
        if r.sparse:
            hit = np.frombuffer(r.bits, dtype=np.uint16)
            np.bitwise_or.at(own, hit >> 3, np.uint8(1) << (hit & 7).astype(np.uint8))
        else:
            own[:] = np.frombuffer(r.bits, dtype=np.uint8)
    return df.sparkSession.sparkContext.broadcast(planes)


def reaches(planes: np.ndarray, values: np.ndarray, level: int) -> np.ndarray:
    """Whether each value's estimate reaches the level with that index; never False for one that does."""
    bits = planes.shape[2].bit_length() - 1 + 3
    out = np.ones(len(values), dtype=bool)
    for row in range(planes.shape[0]):
        c = cells_of(values, row, bits)
        out &= (planes[row, level][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return out


def _sliced(values: np.ndarray) -> np.ndarray:
    """42 bits of each value's hash: the slice, then 32 bits that tell values of a slice apart."""
    return mix(values, 200) >> np.uint64(64 - 32 - _SLICES)


def _places(low: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Where a value's bits are in its slice of a filter of 2**bits bits."""
    for odd in _ODD:
        yield (low.astype(np.uint32) * np.uint32(odd)) >> np.uint32(32 - (bits - _SLICES))


def repeated(df: DataFrame, values: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> Broadcast:
    """A Bloom filter of 2**bits bits, broadcast, of the 64-bit `values` of all batches of `df` that occur more than once."""
    bits = max(bits, _SLICES + 3)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            h = np.sort(_sliced(np.concatenate(held)))
            held.clear()
            keep = np.ones(len(h), dtype=bool)
            keep[2:] = h[2:] != h[:-2]
            h = h[keep]
            at = np.searchsorted(h, np.arange((1 << _SLICES) + 1, dtype=np.uint64) << np.uint64(32))
            low, own = h.astype(np.uint32), np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_arrays([pa.array(own, type=pa.int32()), pa.array([low[at[i] : at[i + 1]].tobytes() for i in own], type=pa.binary())], names=["slice", "low"])

        for v in values(batches):
            held.append(v)
            n += len(v)
            if n >= _HELD:
                yield flush()
                n = 0
        if n:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices arrive one after the other, so that one slice's values are held at a time."""
        now, held = None, []

        def done() -> pa.RecordBatch:
            low = np.sort(np.frombuffer(b"".join(held), dtype=np.uint32))
            more = low[1:][low[1:] == low[:-1]]
            hit = np.zeros(1 << (bits - _SLICES), dtype=bool)
            for place in _places(more, bits):
                hit[place] = True
            return pa.RecordBatch.from_arrays([pa.array([now], type=pa.int32()), pa.array([np.packbits(hit, bitorder="little").tobytes()], type=pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for slice_, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if slice_ != now:
                    if now is not None:
                        yield done()
                    now = slice_
                    held.clear()
                held.append(low)
        if now is not None:
            yield done()

    plane = np.zeros((1 << _SLICES, 1 << (bits - _SLICES - 3)), dtype=np.uint8)
    merged = df.mapInArrow(tidy(partial), "slice int, low binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(tidy(merge), "slice int, bits binary")
    for r in merged.repartition(8).toLocalIterator():
        plane[r.slice] = np.frombuffer(r.bits, dtype=np.uint8)
    return df.sparkSession.sparkContext.broadcast(plane)


def holds(plane: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the filter of repeated() holds each value; never False for one that occurs more than once."""
    bits = plane.size.bit_length() - 1 + 3
    h = _sliced(values)
    row, out = (h >> np.uint64(32)).astype(np.int64), np.ones(len(values), dtype=bool)
    for place in _places(h, bits):
        out &= (plane[row, place >> np.uint32(3)] >> (place & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return out
