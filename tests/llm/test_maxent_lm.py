"""The language model against counts by definition, sums of all probabilities, naive softmaxes and held-out texts."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from envatlas.llm import maxent_lm, queries

SCHEMA = "doc_id bigint, text string"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def base(rows):
    """doc_id, n_tokens, n_known, train_tokens and base score by definition."""
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    topics = [[f"{k}{x}" for x in range(40)] for k in "abc"]
    out = []
    for i in range(240):
        own = topics[i % 3]
        out.append((i, " ".join(rng.choice(own) for _ in range(rng.randint(0, 60)))))
    return [*out, (500, None), (501, ""), (502, " \t\r\n"), (503, "A a É é\x0bB"), (504, "unseen-" * 3 + " word"), (504, "unseen word"), (None, "a1 a2"), (505, "a0 " * 3000)]


def close(a, b):
    return a == pytest.approx(b, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_counts_and_gain(spark, rows, block, monkeypatch):
    monkeypatch.setattr(maxent_lm, "BLOCK_BYTES", block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = maxent_lm.score(df, held_out()).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    for g, w in zip(sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(base(rows), key=key), strict=True):
        assert g[:5] == w[:5] and close(g[5], w[5])
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) and len(unseen) > 20


def test_probabilities_sum_to_one(spark, rows):
    encoded, counts, names, (tail, ids, k) = maxent_lm.encode(spark.createDataFrame(rows, SCHEMA), "text", held_out())
    model = maxent_lm.train(encoded, counts, "held_out", ids, k)
    assert counts.tokens == base(rows)[0][4] and len(counts.head) == counts.kinds - sum(counts.tail_kinds)
    events = np.array([*range(len(counts.head)), *range(model.head, model.head + maxent_lm.TAIL_CLASSES)])
    for one, two in ((model.head + maxent_lm.TAIL_CLASSES, model.head + maxent_lm.TAIL_CLASSES), (0, 5), (7, model.head + 3)):
        p = maxent_lm.log10_probabilities(model, events, np.full(len(events), one), np.full(len(events), two))
        assert (10.0**p).sum() == pytest.approx(1, abs=1e-4)
    # by hand for one history
    one, two = np.array([7]), np.array([3])
    logits = model.class_bias + sum(model.classes[int(r[0])] for r in (maxent_lm._rows(1, one), maxent_lm._rows(2, two), maxent_lm._rows(3, one, two)))
    c = 9 % maxent_lm.HEAD_CLASSES
    inner = model.word_bias[c] + sum(model.words[int(r[0])] for r in (maxent_lm._rows(4, one, np.array([c])), maxent_lm._rows(5, two, np.array([c])), maxent_lm._rows(6, one, two, np.array([c]))))
    softmax = lambda x, i: math.log10(math.exp(x[i]) / sum(math.exp(y) for y in x if y > -math.inf))
    got = maxent_lm.log10_probabilities(model, np.array([9]), one, two)[0]
    assert got == pytest.approx(softmax(logits, c) + softmax(inner, 9 // maxent_lm.HEAD_CLASSES), abs=1e-4)


def test_tail_is_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HEAD_CLASSES", 2)
    monkeypatch.setattr(maxent_lm, "CLASS_WORDS", 3)
    monkeypatch.setattr(maxent_lm, "TAIL_CLASSES", 4)
    encoded, counts, _, (tail, ids, k) = maxent_lm.encode(spark.createDataFrame(rows, SCHEMA), "text", held_out())
    n = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    head = [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:6]]
    assert counts.head == [n[w] for w in head] and sum(counts.tail_tokens) == sum(n.values()) - sum(counts.head) and sum(counts.tail_kinds) == len(n) - 6
    texts = {r[0]: r[1] for r in rows if r[0] != 504}
    classes = {}
    for r in encoded.collect():
        if r.doc_id in texts:
            symbols, want = np.frombuffer(r[ids], dtype=np.uint16).tolist(), 0.0
            for s, w in zip(symbols, tokens(texts[r.doc_id]), strict=True):
                if w in head:
                    assert s == head.index(w)
                else:
                    assert classes.setdefault(w, s - 6) == s - 6
                    want += math.log10((n[w] + 1) / (counts.tail_tokens[s - 6] + counts.tail_kinds[s - 6] + 1))
            assert close(r[tail], want)


def test_learners_agree_and_order_is_of_no_effect(spark, rows, monkeypatch):
    df = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA).coalesce(1)
    once = {(r.doc_id, r.n_tokens): r.score for r in maxent_lm.score(df, held_out()).collect()}
    again = {(r.doc_id, r.n_tokens): r.score for r in maxent_lm.score(df, held_out()).collect()}
    assert once == again
    monkeypatch.setattr(maxent_lm, "LEARNER_TOKENS", 700)
    many = {(r.doc_id, r.n_tokens): r.score for r in maxent_lm.score(df, held_out()).collect()}
    assert sum(many.values()) == pytest.approx(sum(once.values()), rel=0.2)


def test_edge_tables(spark):
    assert maxent_lm.score(spark.createDataFrame([], SCHEMA), held_out()).count() == 0
    only = next(i for i in range(100) if held(i))
    got = maxent_lm.score(spark.createDataFrame([(only, "some words"), (only, None)], SCHEMA), held_out()).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 2 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    named = spark.createDataFrame([(1, "a b", "own", [1], "k")], "doc_id bigint, text string, Score string, held_out array<int>, k string")
    out = maxent_lm.score(named, F.lit(False))
    assert out.columns == ["doc_id", "Score", "held_out", "k", "held_out_", "n_tokens", "n_known", "train_tokens", "base_score", "score_"] and out.first().Score == "own"
    broken = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text union all select 3L, 'fine'")
    assert all(math.isfinite(r.score) for r in maxent_lm.score(broken, held_out()).collect())


def test_registered_language_model(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op11_maxent_lm(spark, at).collect()}
    for i, h, n, known, all_, score in base(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, all_) and close(r.base_score, score)
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
