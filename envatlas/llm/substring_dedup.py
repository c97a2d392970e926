"""Substring dedup: words of passages that start anywhere else go, with a count-min prefilter before the exact grouping.

A window is `size` consecutive words of one document. A window can be repeated only if each shorter run of words inside it
is. First pass: partition sketches count those 16-word runs whose hash is divisible by 4, of all documents, and are merged;
an estimate is never too low, so a window with an inner run estimated once is unique and needs no more. (About one window in 300
has no such run and goes on unfiltered.) Second pass: windows left are grouped exactly, by a 95-bit hash of their word sequence. They travel as stretches of consecutive windows under one
minimizer (the least hash of the 8-word runs inside): equal windows have equal minimizers and so meet in one task. A window
that a task meets again is known to be repeated at once; only its first copy travels, so the largest group of copies costs
one row a task. Third, the stretches found repeated are applied to the whole texts.

Windows are judged on the input, not on what is left. Null or empty text has no words; a text shorter than a window
loses nothing; equal rows repeat each other. Rows are told apart by id and text, so null and repeated ids are fine. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envatlas.llm.arrowtext import Words, inside, mix, runs, words
from envatlas.llm.shared import column_named, tidy
from envatlas.llm.sketch import reaches, sketch

WINDOW = 35
#: Cells of each of the sketch's two rows, as a power of two: 32 MB of bits a row, at any size of input.
SKETCH_BITS = 28
SKETCH_ROWS = 2
#: Words of the inner runs that the sketch counts, and the divisor of their hashes.
INNER = 16
ONE_IN = 4
_MINIMIZER = 8
_HELD = 1 << 19


def _windows(part: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a chunk, its windows' hashes and their places (index of the first word)."""
    h = part.hashes()
    at = np.flatnonzero(inside(part.at, size))
    return h, runs(h, size)[at], at


def _inner(part: Words, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the inner runs of a chunk that the sketch counts."""
    k = min(INNER, size)
    low = runs(h, k, 2)
    at = np.flatnonzero(inside(part.at, k) & (low % np.uint64(ONE_IN) == 0))
    return low[at], at


def _minimizers(h: np.ndarray, size: int) -> np.ndarray:
    """For each place the least hash of the short runs inside the window that starts there."""
    k = min(_MINIMIZER, size)
    low = mix(runs(h, k), 9)
    span, out = size - k + 1, low
    done = 1
    while done < span:
        step = min(done, span - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def repeated_stretches(df: DataFrame, text: str = "text", key: str = "key", size: int = WINDOW, bits: int = SKETCH_BITS) -> DataFrame:
    """(key, start, n): n consecutive windows from word `start` on are repeated; a row's stretches may overlap or repeat.

    `key` must tell rows of different texts apart.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in words(batch.column(0)):
            yield _inner(part, part.hashes(), size)[0]

    planes = sketch(rows.select("text"), hashes, bits, SKETCH_ROWS, [2])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for part in words(batch.column(1)):
                h, w, at = _windows(part, size)
                inner, places = _inner(part, h, size)
                unique = np.zeros(len(h) + 1, dtype=np.int32)
                unique[places[~reaches(planes.value, inner, 0)] + 1] = 1
                np.cumsum(unique, out=unique)
                hit = unique[at + size - min(INNER, size) + 1] == unique[at]
                if not hit.any():
                    continue
                at, w = at[hit], w[hit]
                doc = np.searchsorted(part.at, at, side="right") - 1
                held.append((keys[part.first + doc], at - part.at[doc], w, runs(part.hashes(1), size, 1)[at], _minimizers(h, size)[at]))
                n += len(at)
            if n >= _HELD:
                yield _stretches(held)
                held, n = [], 0
        if n:
            yield _stretches(held)

    found = rows.mapInArrow(tidy(second), "mini long, key long, start int, n int, hashes binary")
    # a stretch that is known to be repeated has no hashes; it goes on by its own key
    dealt = found.repartition(F.coalesce("mini", "key")).sortWithinPartitions("mini")
    return dealt.mapInArrow(tidy(_confirm), "key long, start int, n int")


def _stretches(held: list[tuple]) -> pa.RecordBatch:
    """Rows of consecutive windows: first copies with their hashes under a minimizer, and what is repeated here already."""
    key, start, w1, w2, mini = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((w2, w1))
    a, b = w1[order], w2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    often = np.zeros(len(a), dtype=bool)
    often[order] = np.bincount(group)[group] > 1
    first = np.zeros(len(a), dtype=bool)
    first[order] = new
    out: list[list] = [[], [], [], [], []]

    def add(keep: np.ndarray, with_hashes: bool) -> None:
        if not len(keep):
            return
        k, s, m = key[keep], start[keep], mini[keep]
        cut = np.ones(len(keep), dtype=bool)
        cut[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1)
        if with_hashes:
            cut[1:] |= m[1:] != m[:-1]
            blob = np.empty((len(keep), 3), dtype=np.uint32)
            blob[:, :2] = w1[keep].view(np.uint32).reshape(-1, 2)
            blob[:, 2] = ((w2[keep] >> np.uint64(33)) << np.uint64(1)).astype(np.uint32) | often[keep].astype(np.uint32)
            raw = blob.tobytes()
        at = np.flatnonzero(cut)
        ends = [*at[1:].tolist(), len(keep)]
        out[0].extend(m[at].view(np.int64).tolist() if with_hashes else [None] * len(at))
        out[1].extend(k[at].tolist())
        out[2].extend(s[at].tolist())
        out[3].extend((np.array(ends) - at).tolist())
        out[4].extend([raw[12 * x : 12 * y] for x, y in zip(at.tolist(), ends, strict=True)] if with_hashes else [None] * len(at))

    add(np.flatnonzero(first), True)
    add(np.flatnonzero(often), False)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, types, strict=True)], names=["mini", "key", "start", "n", "hashes"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of windows that stand in a partition more than once, or were seen so before.

    Rows arrive in order of their minimizer and equal windows share one, so runs of whole minimizers are grouped each for itself.
    """
    names = ["key", "start", "n"]
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        known = pc.is_null(batch.column(4))
        yield from pa.table([c.filter(known) for c in batch.columns[1:4]], names=names).to_batches()
        new = batch.filter(pc.invert(known))
        if not len(new):
            continue
        mini = new.column(0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(mini[1:] != mini[:-1]) + 1
        windows = np.cumsum(new.column(3).to_numpy(zero_copy_only=False))
        if held and held[-1].column(0)[-1].as_py() != mini[0]:
            ends = np.append(0, ends)
        at = 0
        for end in ends.tolist():  # a new minimizer starts here
            if size + (windows[end - 1] if end else 0) - (windows[at - 1] if at else 0) >= _HELD:
                held.append(new.slice(at, end - at))
                yield from _grouped(held, names)
                held, size, at = [], 0, end
        held.append(new.slice(at))
        size += int(windows[-1] - (windows[at - 1] if at else 0))
    if held:
        yield from _grouped(held, names)


def _grouped(held: list[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    key, start, n = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (1, 2, 3))
    if not len(key):
        return
    blob = np.frombuffer(b"".join([x for b in held for x in b.column(4).to_pylist()]), dtype=np.uint32).reshape(-1, 3)
    w1 = np.ascontiguousarray(blob[:, :2]).view(np.uint64).ravel()
    w2, often = blob[:, 2] >> np.uint32(1), (blob[:, 2] & np.uint32(1)) == 1
    order = np.lexsort((w2, w1))
    a, b = w1[order], w2[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    hit = np.zeros(len(a), dtype=bool)
    hit[order] = (np.bincount(group) > 1)[group] | (np.bincount(group, often[order]) > 0)[group]
    row = np.repeat(np.arange(len(key)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    row, place = row[hit], place[hit]
    if len(row):
        cut = np.ones(len(row), dtype=bool)
        cut[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.flatnonzero(cut)
        length = np.diff([*at, len(row)])
        yield pa.RecordBatch.from_arrays([pa.array(key[row[at]]), pa.array(place[at].astype(np.int32)), pa.array(length.astype(np.int32))], names=names)


def dedup(df: DataFrame, text: str = "text", ident: str = "doc_id", size: int = WINDOW, bits: int = SKETCH_BITS, with_text: bool = False) -> DataFrame:
    """The input's columns but the text, and n_words, n_removed, kept_sha256; with `with_text` also kept_text.

    Words kept stand unchanged and joined by one space. Clashing names: the operator's columns take trailing underscores.
    """
    key = column_named(df, "key")
    keyed = df.withColumn(key, F.xxhash64(F.col(ident).cast("string"), F.col(text)))
    found = repeated_stretches(keyed, text, key, size, bits)
    spans = found.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    both = keyed.join(spans, key, "left").drop(key)
    kept = [f for f in df.schema.fields if f.name != text]
    own = [(column_named(df, c), t) for c, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()))]
    own = own if with_text else own[:3]
    schema = T.StructType([*kept, *(T.StructField(c, t) for c, t in own)])
    where, last, keep = both.columns.index(text), len(both.columns) - 1, [both.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, sums, texts = [], [], [], []
            spans_ = batch.column(last).to_pylist()
            for part in words(batch.column(where)):
                for i, (a, b) in enumerate(zip(part.at[:-1].tolist(), part.at[1:].tolist(), strict=True)):
                    gone = np.zeros(b - a + 1, dtype=np.int32)
                    for s in spans_[part.first + i] or ():
                        gone[s["start"]] += 1
                        gone[s["start"] + s["n"] + size - 1] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    starts, ends = part.starts[a:b][stay], part.ends[a:b][stay]
                    # whole stretches between white space that is one blank already are copied at once
                    lone = np.ones(len(starts), dtype=bool)
                    lone[1:] = (starts[1:] != ends[:-1] + 1) | (part.data[ends[:-1]] != 0x20) if len(starts) > 1 else True
                    at = np.flatnonzero(lone)
                    tails = ends[[*(at[1:] - 1), len(ends) - 1]] if len(at) else []
                    raw = part.data.tobytes() if len(part.at) == 2 else None  # of one document alone
                    pieces = [(raw[x:y] if raw is not None else part.data[x:y].tobytes()) for x, y in zip(starts[at].tolist(), list(tails), strict=True)]
                    text_ = b" ".join(pieces)
                    total.append(b - a)
                    removed.append(int(b - a - stay.sum()))
                    sums.append(hashlib.sha256(text_).hexdigest())
                    if with_text:
                        texts.append(text_.decode())
            arrays = [pa.array(total, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(sums, type=pa.string()), *([pa.array(texts, type=pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *arrays], names=[f.name for f in schema.fields])

    return both.mapInArrow(tidy(run), schema)
