"""Words, n-grams and their hashes, computed with numpy straight on Arrow's text buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. No Python string is made for it: a batch's UTF-8
bytes are scanned as one array, and a word's hash is a difference of two prefix sums.
Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.have = base, _powers(base, 1 << 16)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.have[0]) < n:
            self.have = _powers(self.base, 1 << (n - 1).bit_length())
        return self.have


_BYTE, _WORD = (_Powers(_BASE), _Powers(np.uint64(0xD6E8FEB86659FD93))), _Powers(_STEP)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of documents first..first + n: spans in `data`, and each document's range of words in `at` (n + 1)."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    lower: bool

    def hashes(self, kind: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; the two kinds are independent. Memory for scratch is a few times `CHUNK_BYTES`, however long a text."""
        out, i = np.empty(len(self.starts), dtype=np.uint64), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + CHUNK_BYTES, side="right")))
            starts, ends = self.starts[i:j], self.ends[i:j]
            first, last = int(starts[0]), int(ends[-1])
            if last - first > CHUNK_BYTES:  # one word of that length
                total = np.uint64(0)
                for a in range(first, last, CHUNK_BYTES):
                    data, power, _ = self._weighed(a, min(last, a + CHUNK_BYTES), kind)
                    ahead = np.uint64(pow(int(_BYTE[kind].base), a - first, 1 << 64))
                    total = (np.array([(data * power).sum(dtype=np.uint64)]) * ahead + total)[0]
                sums = np.array([total], dtype=np.uint64)
            else:
                data, power, inverse = self._weighed(first, last, kind)
                upto = np.zeros(len(data) + 1, dtype=np.uint64)
                np.cumsum(data * power, out=upto[1:])
                sums = (upto[ends - first] - upto[starts - first]) * inverse[starts - first]
            out[i:j] = mix(sums + (ends - starts).astype(np.uint64), 7 * kind)
            i = j
        return out

    def _weighed(self, a: int, b: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes a to b plus one, and the powers (and their inverses) that weigh them."""
        data = _LOWER[self.data[a:b]] if self.lower else self.data[a:b]
        power, inverse = _BYTE[kind].upto(b - a + 1)
        return data.astype(np.uint64) + np.uint64(1), power[: b - a], inverse

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def words(column: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a column's texts, by chunks of whole documents of about `chunk` bytes."""
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, side="right")) - 1)
        part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        space = _SPACE[part]
        before, after = np.empty_like(space), np.empty_like(space)
        if len(space):
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
            before[cut[:-1][cut[:-1] < len(space)]] = True
            after[cut[1:][cut[1:] > 0] - 1] = True
        np.logical_not(space, out=space)
        starts, ends = np.flatnonzero(space & before), np.flatnonzero(space & after) + 1
        yield Words(i, part, starts, ends, np.searchsorted(starts, cut), lower)
        i = j


def runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each k consecutive values (len - k + 1 of them), the same wherever they stand."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _WORD.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((mix(hashes, salt) if salt else hashes) * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * inverse[: n - k + 1], salt + k)


def inside(at: np.ndarray, k: int) -> np.ndarray:
    """For each k consecutive words of a chunk, whether they stand in one document."""
    n = int(at[-1])
    if n < k:
        return np.zeros(0, dtype=bool)
    ok = np.ones(n - k + 1, dtype=bool)
    if k > 1:
        ends = np.unique(at[1:-1])
        bad = (ends[:, None] - np.arange(1, k)[None, :]).ravel()
        ok[bad[(bad >= 0) & (bad < len(ok))]] = False
    return ok


def shingle_sets(part: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each document of a chunk, as sorted hashes and their offsets by document.

    With 1 to k - 1 words the whole sequence is one shingle; without words the set is empty.
    """
    h, counts, at = part.hashes(), part.counts(), part.at
    ok = inside(at, k)
    doc = np.repeat(np.arange(len(counts)), counts)
    values, owner = runs(h, k)[ok], doc[: len(ok)][ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.array([runs(h[at[d] : at[d + 1]], int(counts[d]))[0] for d in short], dtype=np.uint64)
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))
