"""Language identification with hyperdimensional profiles.

Each letter has a random vector of -1 and 1, drawn from the letter's code point and a seed. The vector of an n-gram binds
its letters' vectors, each permuted (rotated) by its place, by elementwise product; a document bundles (adds) the vectors
of its n-grams; a language's prototype bundles its documents, each at unit length so that long ones don't outweigh others.
A document gets the language whose prototype has the largest cosine with its own vector. Words are padded with one blank on
each side, and all that is not a letter counts as blank.

Whole texts are read. Null text, or text without a letter, gets `und` and score 0. With no labelled rows to learn from every
document gets `und`. Ties go to the language that comes first by code point. Repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envatlas.llm.shared import column_named, tidy

DIMENSIONS = 512
N = 3
SEED = 7
#: Bound on the documents learned from, as expected by a seeded draw; each language gets an equal part of it.
MOST_TRAINING_DOCS = 24_000
UNKNOWN = "und"
_CHUNK = 1 << 19


@lru_cache(1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in (*range(0xD800), *range(0xE000, 0x110000)):
        if (s := chr(c)).isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@lru_cache(8192)
def _letter(code: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, code]).choice(np.array([-1, 1], dtype=np.int8), dimensions)


def vectors(texts: list[str | None], dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED) -> Iterator[tuple[int, np.ndarray]]:
    """(first index, matrix): the bundled vectors of runs of texts; a text without a letter has a zero vector.

    Texts of more than a chunk are bundled chunk by chunk, each with one character of context on either side, so that memory
    does not grow with a text. That context is enough for n-grams of up to three letters.
    """
    if n > 3:
        raise ValueError("n-grams have up to three letters")
    i = 0
    while i < len(texts):
        long = texts[i] or ""
        if len(long) > _CHUNK:
            total = np.zeros((1, dimensions), dtype=np.float64)
            for a in range(0, len(long), _CHUNK):
                b = min(len(long), a + _CHUNK)
                total += _bundled([long[max(0, a - 1) : b + 1]], min(a, 1), b - a, dimensions, n, seed)
            yield i, total.astype(np.float32)
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= _CHUNK and j - i < 256):
            size += len(texts[j] or "")
            j += 1
        yield i, _bundled([t or "" for t in texts[i:j]], 0, None, dimensions, n, seed)
        i = j


def _bundled(texts: list[str], lead: int, many: int | None, dimensions: int, n: int, seed: int) -> np.ndarray:
    """The bundled vectors of some texts; with `many`, of the only text's characters from `lead` on, the others being context."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    flat = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])  # each text with the blank before it
    code = _folded()[flat]
    at = np.flatnonzero(np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)]))  # runs of blanks to one
    code = code[at]
    letters, local = np.unique(code, return_inverse=True)
    base = np.int64(max(2, len(letters)))
    grams = np.zeros(max(0, len(local) - n + 1), dtype=np.int64)
    for k in range(n):
        grams = grams * base + local[k : len(local) - n + 1 + k]
    middle = at[n // 2 : n // 2 + len(grams)]
    ok = code[n // 2 : n // 2 + len(grams)] != 0
    if many is not None:
        ok &= (middle > lead) & (middle <= lead + many)
    grams, own = grams[ok], np.searchsorted(ends, middle[ok], side="right") - 1
    kinds, which = np.unique(grams, return_inverse=True)
    for a in range(0, len(kinds), 8192):  # bounds memory with any alphabet
        b = min(len(kinds), a + 8192)
        digits = kinds[a:b, None] // base ** np.arange(n, dtype=np.int64) % base  # the last letter first
        some, place = np.unique(digits, return_inverse=True)
        alone = np.stack([_letter(int(letters[c]), dimensions, seed) for c in some])
        table = np.ones((b - a, dimensions), dtype=np.int8)
        for k, of in enumerate(place.reshape(digits.shape).T):
            table *= np.roll(alone, k, axis=1)[of]
        hit = (which >= a) & (which < b)
        counts = np.bincount(own[hit] * (b - a) + (which[hit] - a), minlength=len(texts) * (b - a)).astype(np.float32)
        out += counts.reshape(len(texts), b - a) @ table.astype(np.float32)
    return out


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED, most: int = MOST_TRAINING_DOCS, spread: str | None = "doc_id") -> dict[str, np.ndarray]:
    """Unit prototypes by language, from about `most` labelled rows at most, drawn by a seeded hash of text and `spread`.

    Rows with null text or language are left out. `spread`, where `labelled` has it, tells copies of one text apart in the draw, so that the bound
    holds with any number of copies; of the rows drawn each distinct text of a language counts once. Vectors are summed as whole numbers, so
    that the order of tasks is of no effect, and the driver gets `dimensions` numbers a language.
    """
    more = [F.col(spread).alias("spread")] if spread and spread in labelled.columns else []
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), *more).where("lang is not null and text is not null")
    have = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not have:
        return {}
    share = {k: min(1.0, most / len(have) / v) for k, v in have.items()}
    shares = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)])
    draw = F.pmod(F.xxhash64(F.lit(seed), "text", *[F.col("spread").cast("string") for _ in more]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.where(draw < shares[F.col("lang")]).select("lang", "text").distinct()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, m in vectors(batch.column(1).to_pylist(), dimensions, n, seed):
                m = np.rint(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9) * (1 << 20)).astype(np.int64)
                for k in set(langs[i : i + len(m)]):
                    sums[k] = sums.get(k, 0) + m[[x == k for x in langs[i : i + len(m)]]].sum(axis=0)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "i", "v"])

    out = {k: np.zeros(dimensions) for k in sorted(have)}
    for r in rows.mapInArrow(tidy(partial), "lang string, i int, v bigint").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect():
        out[r.lang][r.i] = r.v
    return {k: v / norm for k, v in out.items() if (norm := float(np.linalg.norm(v)))}


def predict(df: DataFrame, model: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED) -> DataFrame:
    """Adds lang_pred and score, the largest cosine cut to 0..1; clashing columns keep their names."""
    own = column_named(df, "lang_pred"), column_named(df, "score")
    schema = T.StructType([*df.schema.fields, T.StructField(own[0], T.StringType()), T.StructField(own[1], T.DoubleType())])
    where, names = df.columns.index(text), sorted(model)
    prototypes = np.array([model[k] for k in names], dtype=np.float32).reshape(len(names), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, m in vectors(batch.column(where).to_pylist(), dimensions, n, seed):
                norm = np.linalg.norm(m, axis=1)
                cosine = m @ prototypes.T / np.maximum(norm, 1e-9)[:, None] if names else np.zeros((len(m), 0))
                for i in range(len(m)):
                    if not names or not norm[i]:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(cosine[i].argmax())
                        langs.append(names[best])
                        scores.append(float(min(1.0, max(0.0, cosine[i, best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=[f.name for f in schema.fields])

    return df.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 4 is 2; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
