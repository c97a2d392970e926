"""Whitening against exact fractions and against numpy, on hard rows and at the ends of the number range."""

from fractions import Fraction

import numpy as np
import pytest

from envatlas.llm import queries, whitening

VECTOR = "vec_id bigint, embedding array<float>"


def brute(rows, components=4):
    """The contract with exact fractions for the covariance."""
    use = [(i, [int(np.floor(256 * np.float64(c))) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in use})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    v = np.array([[float(sum((x[a] - Fraction(s[a], n)) * (x[b] - Fraction(s[b], n)) for x in fit) / n) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in use:
        deviation = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        for k in range(min(components, d)):
            w = float(np.dot(np.array(x) - np.array(s) / n, u[:, k]) / np.sqrt(e[k])) if e[k] > 1e-9 else None
            out.setdefault((i, k + 1), []).append((n, deviation, w, e[k] / np.trace(v)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    scales = np.array([3.0, 2.0, 1.0, 0.5, 0.2, 0.1])
    base = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * scales]) for i in range(200)]
    nan, inf = float("nan"), float("inf")
    hard = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [nan, 0.0, 0.0, 0.0, 0.0, 0.0]), (303, [0.0, 0.0, inf, 0.0, 0.0, 0.0]), (304, [0.0] * 6), (305, [-0.0] * 6), (306, []), (None, base[0][1]), (7, base[7][1])]
    return base + [(i + 400, base[3][1]) for i in range(150)] + hard


def test_whitening_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, VECTOR).repartition(7)
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 6])
    got = {}
    out = whitening.whiten(df)
    for r in out.collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
        assert r.identity_error < 1e-9
    assert set(got) == set(want) and all(len(got[k]) == len(want[k]) for k in want)
    sign = {k: np.sign(got[(0, k)][0].whitened * want[(0, k)][0][2]) for k in range(1, 5)}
    for key in want:
        for g, (n, deviation, w, explained) in zip(got[key], want[key], strict=True):
            assert g.n == n and int(g.deviation) == deviation
            assert g.whitened * sign[key[1]] == pytest.approx(w, abs=1e-9) and g.explained == pytest.approx(explained, rel=1e-9)


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-(1 << 61), 1 << 61, (50, 3)).tolist()
    how = whitening.fit(spark.createDataFrame([(v,) for v in x], "x array<bigint>").repartition(3), 3)
    assert how.n == 50 and how.sums == [sum(v[j] for v in x) for j in range(3)]
    assert how.scatter == [[sum(v[a] * v[b] for v in x) for b in range(3)] for a in range(3)]
    primes = whitening.primes_above(1 << 100)
    assert len(primes) == 5 and np.prod([float(p) for p in primes]) > 2.0**100
    big = rng.integers(-(1 << 40), 1 << 40, (10_000, 4))
    exact = big.astype(object).T @ big.astype(object)
    assert (whitening.remaindered([whitening.modular_scatter(big, p) for p in whitening.primes_above(1 << 120)], whitening.primes_above(1 << 120)) == exact).all()


def test_whitening_of_edge_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTOR)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], VECTOR)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3, VECTOR)).collect()
    assert [(r.vec_id, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None)] * 6
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.5, 1.0])], VECTOR)).collect()
    assert sorted((r.vec_id, r.component, r.whitened) for r in flat if r.component == 1) in ([(1, 1, -1.0), (2, 1, 1.0)], [(1, 1, 1.0), (2, 1, -1.0)])
    assert all(r.whitened is None and r.explained == 0 and r.identity_error < 1e-12 for r in flat if r.component == 2 or r.identity_error >= 1e-12)
    far = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], VECTOR)).collect()
    assert len(far) == 6 and {r.n for r in far} == {3}
    named = spark.createDataFrame([(1, [0.5, 1.0], "own", 2), (2, [1.5, 1.0], "own", 2)], "vec_id bigint, embedding array<float>, Whitened string, x int")
    out = whitening.whiten(named, components=1)
    assert out.columns == ["vec_id", "Whitened", "x", "component", "n", "deviation", "whitened_", "explained", "identity_error"] and {r.Whitened for r in out.collect()} == {"own"}


def test_registered_whitening(spark):
    at = "/root/testdata/sf0.001"
    got = queries.op12_whitening(spark, at).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    use = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows]
    x = np.unique(np.array([v for _, v in use]), axis=0)
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    assert len(got) == 4 * len(rows)
    own = {i: int(((n * v - s) ** 2).sum()) for i, v in use}
    for r in got:
        assert r.n == n and r.deviation == own[r.vec_id] and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9
