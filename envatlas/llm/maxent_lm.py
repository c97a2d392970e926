"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Words are lower-cased in A-Z and end with one end token a text. The most frequent `HEAD_CLASSES * CLASS_WORDS` words, the head, are dealt to classes by frequency, one after the other;
all others, the tail, have a class by their last two letters. P(word | history) = P(class | history) * P(word | class, history). Both factors are softmaxes over sums
of weights, one row of a table for each feature of the history: the word before (n-gram of two), the two words before (of three) and the word before that alone (a skip).
A feature's row is its hash, so that the tables' size is fixed. Within a tail class the second factor is exact: (c + 1) / (N + V + 1) by counts over all training
texts, the 1 being that of a word never seen, of which each tail class has one kind. So the probabilities of all words, and of unseen ones by class, sum to 1.

Training: biases start as the logarithms of exact counts. The training texts are dealt by hash to rounds and learners of about `LEARNER_TOKENS`
tokens; in a round each learner takes gradient steps (AdaGrad) over small batches from the same weights, and rows of the tables are averaged over the learners that touched them, each by
how often. A task holds the tables and one batch, the driver one copy of the tables. Every training text is used once; its order is that of a hash, so that
reruns over the same files agree.

Counts: see blocks.py; a block returns a row for each distinct word in it. Null and empty texts are one end token. Repeated rows count each time. An empty table gives none; without
training texts base scores are 0 and every token is an unseen word. Ties in frequency go to the word that comes first by bytes. Other columns pass through, and of clashing names the operator's own takes
trailing underscores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envatlas.llm.arrowtext import mix
from envatlas.llm.blocks import Numbered, chunks, items, met, packed, unpacked
from envatlas.llm.shared import drop, save, tidy

BLOCK_BYTES = 8 << 20
HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 32, 64, 32
#: Rows of either table, a power of two.
ROWS = 1 << 15
ROUNDS = 2
LEARNER_TOKENS = 8_000_000
_STEP, _BATCH, _RATE = 4096, 1 << 14, 0.15
_END = b""
_PART = 1 << 10
_SHORT = 8


@dataclass
class Model:
    """Weights of class features and of word features by class, and the exact counts behind the biases."""

    classes: np.ndarray  # rows x classes
    class_bias: np.ndarray
    words: np.ndarray  # rows x words of a class
    word_bias: np.ndarray  # classes x words of a class; -inf where the class has no such word

    @property
    def head(self) -> int:
        return self.word_bias.size


@dataclass
class Counts:
    """What the training texts hold: all tokens, distinct ones, and by tail class the tokens and distinct words outside the head."""

    tokens: int
    kinds: int
    head: list[int]
    tail_tokens: list[int]
    tail_kinds: list[int]


def _rows(kind: int, *parts: np.ndarray) -> np.ndarray:
    x = np.full(len(parts[0]), kind, dtype=np.uint64)
    for p in parts:
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64) + np.uint64(1))
    return (x & np.uint64(ROWS - 1)).astype(np.uint16 if ROWS <= 1 << 16 else np.int64)


def histories(texts: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, the one before, the one before that) of all tokens of some texts."""
    lead = np.array([start, start], dtype=np.int64)
    flat = np.concatenate([x for t in texts for x in (lead, t)]).astype(np.int64)
    keep = np.ones(len(flat), dtype=bool)
    at = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
    keep[at] = keep[at + 1] = False
    here = np.flatnonzero(keep)
    return flat[here], flat[here - 1], flat[here - 2]


def _softmax(table: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Probabilities of the sums of the features' rows and the bias."""
    logits = table.take(features[0], axis=0)
    for f in features[1:]:
        logits += table.take(f, axis=0)
    logits += bias
    ones = np.ones(logits.shape[1], dtype=np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.exp(logits)
        total = out @ ones
    if not (np.isfinite(total).all() and total.min(initial=1.0) > 1e-30):  # seldom: then by the largest of each row
        out = np.exp(logits - logits.max(axis=1, keepdims=True))
        total = out @ ones
    out *= (1 / total)[:, None]
    return out


def _summed(gradient: np.ndarray, order: np.ndarray, at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sums of runs of rows of gradient[order] that start `at` and are `many` long: the first rows of all runs together, long runs' rest one by one."""
    rows = gradient.take(order, axis=0)
    out = rows.take(at, axis=0)
    for r in range(1, _SHORT):
        i = np.flatnonzero(many > r)
        if not len(i):
            return out
        out[i] += rows.take(at[i] + r, axis=0)
    for i in np.flatnonzero(many > _SHORT):
        out[i] += rows[at[i] + _SHORT : at[i] + many[i]].sum(axis=0)
    return out


def _class_of(symbols: np.ndarray, head: int) -> np.ndarray:
    """Head words are dealt to classes in turn; tail classes follow the head's."""
    return np.where(symbols < head, symbols % HEAD_CLASSES, symbols - head + HEAD_CLASSES)


def log10_probabilities(model: Model, symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of each symbol after its history: its class and, for head words, the word in it."""
    head, out = model.head, np.zeros(len(symbols))
    for a in range(0, len(symbols), _STEP):
        s, x, y = symbols[a : a + _STEP], one[a : a + _STEP], two[a : a + _STEP]
        k = _class_of(s, head)
        p = _softmax(model.classes, model.class_bias, [_rows(1, x), _rows(2, y), _rows(3, x, y)])
        got = np.log10(p[np.arange(len(s)), k].astype(np.float64))
        i = np.flatnonzero(s < head)
        if len(i):
            c, x, y = k[i], x[i], y[i]
            p = _softmax(model.words, model.word_bias[c], [_rows(4, x, c), _rows(5, y, c), _rows(6, x, y, c)])
            got[i] += np.log10(p[np.arange(len(i)), s[i] // HEAD_CLASSES].astype(np.float64))
        out[a : a + _STEP] = got
    return out


class _Table:
    """A table under training: weights, AdaGrad's sums by row, and how often each row was touched."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.start, self.weights, self.bias = weights, weights.copy(), bias
        self.sums, self.hits = np.full(len(weights), 1e-2, dtype=np.float32), np.zeros(len(weights), dtype=np.int64)

    def step(self, features: list[np.ndarray], gradient: np.ndarray) -> None:
        for f in features:
            order = np.argsort(f, kind="stable")
            rows = f[order]
            at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            many = np.diff(at, append=len(f))
            g, rows = _summed(gradient, order, at, many), rows[at].astype(np.int64)
            self.hits[rows] += many
            self.sums[rows] += np.einsum("ij,ij->i", g, g) / g.shape[1]
            g *= (_RATE / np.sqrt(self.sums[rows]))[:, None]
            self.weights[rows] = self.weights.take(rows, axis=0) - g


def learn_from(classes: _Table, words: _Table, symbols: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Gradient steps over batches of `_STEP` tokens."""
    head = words.bias.size
    for a in range(0, len(symbols), _STEP):
        s, x, y = symbols[a : a + _STEP], one[a : a + _STEP], two[a : a + _STEP]
        k = _class_of(s, head)
        features = [_rows(1, x), _rows(2, y), _rows(3, x, y)]
        p = _softmax(classes.weights, classes.bias, features)
        p[np.arange(len(s)), k] -= 1
        classes.step(features, p)
        i = np.flatnonzero(s < head)
        if len(i):
            c, x, y = k[i], x[i], y[i]
            features = [_rows(4, x, c), _rows(5, y, c), _rows(6, x, y, c)]
            p = _softmax(words.weights, words.bias[c], features)
            p[np.arange(len(i)), s[i] // HEAD_CLASSES] -= 1
            words.step(features, p)


def _start(counts: Counts) -> Model:
    """Weights of 0: the class-factored unigram model of the counts."""
    head = np.zeros((HEAD_CLASSES, CLASS_WORDS))
    for r, c in enumerate(counts.head):
        head[r % HEAD_CLASSES, r // HEAD_CLASSES] = c
    tail = np.array(counts.tail_tokens) + 1.0  # 1 for the words never seen
    mass = np.concatenate([head.sum(axis=1), tail])
    with np.errstate(divide="ignore"):
        class_bias, word_bias = np.log(mass), np.log(head)
    empty = head.sum(axis=1) == 0
    word_bias[empty] = 0.0  # a class without words has no mass either
    kinds = len(mass)
    class_bias -= math.log(mass.sum())  # so that no logit is large
    word_bias -= word_bias.max(axis=1, keepdims=True)
    return Model(np.zeros((ROWS, kinds), dtype=np.float32), class_bias.astype(np.float32), np.zeros((ROWS, CLASS_WORDS), dtype=np.float32), word_bias.astype(np.float32))


def _batches(rows: list[bytes | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first, texts' symbols): runs of about `_BATCH` tokens."""
    i = 0
    while i < len(rows):
        j, size, some = i, 0, []
        while j < len(rows) and (j == i or size + len(some[-1]) <= _BATCH):
            some.append(np.frombuffer(rows[j], dtype=np.uint16))
            size += len(some[-1])
            j += 1
        yield i, some
        i = j


def _round(encoded: DataFrame, model: Model, learners: int) -> Model:
    """One round: every learner from `model` over its rows, tables averaged by touches. encoded: learner, k (order), ids."""
    sc = encoded.sparkSession.sparkContext
    start: Broadcast = sc.broadcast((model.classes, model.class_bias, model.words, model.word_bias))  # of fixed size
    symbols = model.head + TAIL_CLASSES

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tables = None, None

        def done() -> Iterator[pa.RecordBatch]:
            for name, t in enumerate(tables):
                for a in range(0, len(t.weights), _PART):
                    hits = t.hits[a : a + _PART]
                    if hits.any():
                        moved = (t.weights[a : a + _PART] - t.start[a : a + _PART]) * hits[:, None].astype(np.float32)
                        yield pa.RecordBatch.from_arrays([pa.array([name], type=pa.int32()), pa.array([a], type=pa.int32()), pa.array([moved.tobytes()]), pa.array([hits.tobytes()])], names=["name", "a", "moved", "hits"])

        for batch in batches:
            learner, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            cut = [0, *(np.flatnonzero(learner[1:] != learner[:-1]) + 1), len(ids)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                if learner[a] != now:
                    if tables:
                        yield from done()
                    now, v = learner[a], start.value
                    tables = _Table(v[0], v[1]), _Table(v[2], v[3])
                for _, texts in _batches(ids[a:b]):
                    learn_from(*tables, *histories(texts, symbols))
        if tables:
            yield from done()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of a table arrive one after the other; one part's sum is held at a time."""
        now, moved, hits = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], type=pa.int32()), pa.array([now[1]], type=pa.int32()), pa.array([(moved / np.maximum(hits, 1)[:, None]).astype(np.float32).tobytes()])], names=["name", "a", "moved"])
        for batch in batches:
            for name, a, m, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(h, dtype=np.int64)
                m = np.frombuffer(m, dtype=np.float32).reshape(len(h), -1).astype(np.float64)
                if (name, a) != now:
                    if now:
                        yield done()
                    now, moved, hits = (name, a), m.copy(), h.copy()
                else:
                    moved, hits = moved + m, hits + h
        if now:
            yield done()

    rows = encoded.repartition(learners, "learner").sortWithinPartitions("learner", "k").select("learner", "ids")
    parts = rows.mapInArrow(tidy(learn), "name int, a int, moved binary, hits binary")
    out = [model.classes.copy(), model.words.copy()]
    for r in parts.repartition("name", "a").sortWithinPartitions("name", "a", "hits", "moved").mapInArrow(tidy(total), "name int, a int, moved binary").toLocalIterator():
        t = out[r["name"]]
        moved = np.frombuffer(r.moved, dtype=np.float32).reshape(-1, t.shape[1])
        t[r.a : r.a + len(moved)] += moved
    start.unpersist()
    return Model(out[0], model.class_bias, out[1], model.word_bias)


_OWN = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType())]
_BLOCK = [("block", T.LongType()), ("places", T.BinaryType()), ("words", T.ArrayType(T.BinaryType())), ("word_counts", T.ArrayType(T.LongType()))]
_LATE = [("tail_score", T.DoubleType()), ("ids", T.BinaryType()), ("k", T.LongType())]


def _fields(have: list[T.StructField], more: list[tuple[str, T.DataType]]) -> list[T.StructField]:
    out = [T.StructField(f.name, f.dataType, True) for f in have]
    for name, kind in more:
        while name.lower() in {f.name.lower() for f in out}:
            name += "_"
        out.append(T.StructField(name, kind))
    return out


def _numbered(df: DataFrame, text: str, held_out: Column) -> tuple[DataFrame, list[T.StructField], list[str]]:
    """The saved first pass: a row a document (its columns, held_out, its words as numbers) and a row a block (its words, how often training texts hold them)."""
    keep = [f for f in df.schema.fields if f.name != text]
    docs = _fields(keep, _OWN[:1])
    fields = _fields(docs, _BLOCK)
    names, schema = [f.name for f in fields], T.StructType(fields)
    rows = df.select(F.col(text).cast("binary"), *[F.col(f"`{f.name}`") for f in keep], F.coalesce(held_out, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, block in chunks(batches, 0, BLOCK_BYTES):
            number = Numbered({_END: 0})
            split = [np.fromiter(map(number.__getitem__, [*t.lower().split(), _END]), dtype=np.int32) for t in texts]
            learnt = [x for x, held in zip(split, batch.column(batch.num_columns - 1).to_pylist(), strict=True) if not held]
            counts = np.bincount(np.concatenate(learnt), minlength=len(number)) if learnt else np.zeros(len(number), dtype=np.int64)
            some = batch.num_rows
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            own = [pa.array([block] * some), pa.array([packed(x, len(number)) for x in split], type=pa.binary()), *[pa.nulls(some, t) for t in kinds[2:]]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *own], names=names)
            lead = [c.type for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in lead], *[pa.array([v], type=t) for v, t in zip([block, None, list(number), counts], kinds, strict=True)]], names=names)

    return save(rows.mapInArrow(tidy(run), schema), "numbered"), docs, names[len(docs) :]


def _tail_class(word: Column) -> Column:
    """By the last two letters before any closing punctuation, and whether there is some."""
    plain = F.expr("TRIM(TRAILING '.,;:!?' FROM cast(key AS string))").cast("binary")
    closed = F.octet_length(plain) < F.octet_length(word)
    return F.pmod(F.xxhash64(F.substring(plain, -2, 2), closed), F.lit(TAIL_CLASSES)).cast("int")


def encode(df: DataFrame, text: str, held_out: Column) -> tuple[DataFrame, Counts, list[str], list[str]]:
    """Saved rows of the documents with n_tokens, n_known, train_tokens, base_score, tail_score (log10 of tail words in their classes) and ids (symbols); the counts; names."""
    saved, docs, (block, places, words, counts) = _numbered(df, text, held_out)
    per_block = items(saved, block, words, counts)
    totals = save(per_block.groupBy("key").agg(F.sum("n").alias("c")), "counts")
    most = HEAD_CLASSES * CLASS_WORDS
    head = [(r.key, r.c) for r in totals.where("c > 0").orderBy(F.desc("c"), "key").limit(most).collect()]  # the model's own size
    ranks = df.sparkSession.createDataFrame([(bytes(w), i) for i, (w, _) in enumerate(head)], "key binary, rank int")
    ranked = totals.join(F.broadcast(ranks), "key", "left").withColumn("tail", _tail_class(F.col("key")))
    all_ = totals.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    tails = {r.tail: r for r in ranked.where("rank is null and c > 0").groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tail_n, tail_v = [tails[t].n if t in tails else 0 for t in range(TAIL_CLASSES)], [tails[t].v if t in tails else 0 for t in range(TAIL_CLASSES)]
    found = Counts(all_.n or 0, all_.v or 0, [c for _, c in head], tail_n, tail_v)
    back = per_block.select("block", "i", "key").join(ranked, "key").select("block", "i", "c", F.coalesce("rank", F.col("tail") + most).alias("symbol"))
    fields = _fields(docs, _OWN[1:])
    schema = T.StructType(_fields(fields, _LATE))
    names = [f.name for f in schema.fields]
    floor = np.log10(np.array(tail_n, dtype=np.float64) + np.array(tail_v) + 1)
    whole = math.log10(found.tokens + found.kinds + 1)

    def finish(rows: pa.Table, known: pa.Table) -> pa.Table:
        i, n = known.column("i").to_numpy(), known.num_rows
        c, symbol = np.zeros(n), np.zeros(n, dtype=np.int64)
        c[i], symbol[i] = known.column("c").to_numpy(), known.column("symbol").to_numpy()
        more = np.log10(c + 1)
        tail = np.where(symbol >= most, more - floor[np.maximum(symbol - most, 0)], 0.0)
        split = [unpacked(x, n) for x in rows.column(places).to_pylist()]
        ids = [symbol[x].astype(np.uint16).tobytes() for x in split]
        late = [
            pa.array([len(x) for x in split], type=pa.int64()),
            pa.array([int((c[x] > 0).sum()) for x in split], type=pa.int64()),
            pa.array([found.tokens] * len(split), type=pa.int64()),
            pa.array([float(more[x].sum() - whole * len(x)) for x in split], type=pa.float64()),
            pa.array([float(tail[x].sum()) for x in split], type=pa.float64()),
            pa.array(ids, type=pa.binary()),
            rows.column(block),
        ]
        return pa.Table.from_arrays([*[rows.column(f.name) for f in docs], *late], names=names)

    at = {x: names[len(fields) + i] for i, x in enumerate(("tail", "ids", "k"))}
    rows = met(saved.where(F.col(places).isNotNull()).drop(words, counts), block, back, finish, schema)
    # k orders the training texts: by hash, apart for copies in other blocks
    key = F.xxhash64(F.col(at["k"]), F.col(at["ids"]), *[F.col(f"`{f.name}`").cast("string") for f in docs if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))])
    out = save(rows.withColumn(at["k"], key), "encoded")
    drop(saved, totals)
    return out, found, [f.name for f in fields], names[len(fields) :]


def train(encoded: DataFrame, counts: Counts, held_out: str, ids: str, k: str) -> Model:
    """The model after `ROUNDS` rounds over the rows that are not held out; each row takes part in one."""
    learners = max(1, math.ceil(counts.tokens / ROUNDS / LEARNER_TOKENS))
    model = _start(counts)
    rows = encoded.where(~F.col(held_out)).select(F.col(ids).alias("ids"), F.col(k).alias("k"))
    for r in range(ROUNDS if counts.tokens else 0):
        own = rows.where(F.pmod("k", F.lit(ROUNDS)) == r).select("ids", "k", F.pmod(F.shiftright("k", 8), F.lit(learners)).cast("int").alias("learner"))
        model = _round(own, model, learners)
    return model


def score(df: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """The columns of `df` but the text, and held_out, n_tokens, n_known, train_tokens, base_score (log10, add-one unigrams) and score (log10, the model), learning from rows that are not held out."""
    encoded, counts, names, (tail, ids, k) = encode(df, text, held_out)
    held = names[len(df.columns) - 1]
    model = train(encoded, counts, held, ids, k)
    shared: Broadcast = df.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = T.StructType(_fields([encoded.schema[c] for c in names], [("score", T.DoubleType())]))
    symbols = model.head + TAIL_CLASSES
    own = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, late = [], batch.column(len(names)).to_pylist()
            for _, texts in _batches(batch.column(len(names) + 1).to_pylist()):
                p = log10_probabilities(shared.value, *histories(texts, symbols))
                out += np.add.reduceat(p, np.cumsum([0, *(len(t) for t in texts)])[:-1]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([a + b for a, b in zip(out, late, strict=True)], type=pa.float64())], names=own)

    return encoded.select(*[F.col(f"`{c}`") for c in names], tail, ids).mapInArrow(tidy(run), schema)
