"""Queries whose middle must not grow faster than what they read and return."""

from envatlas.operators import scopes
from envatlas.plans import more_queries


def test_overlap_counts_agree_with_the_pairs(spark):
    s = [(f, 100 * f + i, a, a + n) for f in (1, 2) for i, (a, n) in enumerate([(0, 5), (3, 1), (3, 0), (4, 0), (5, 9), (5, 9), (14, 2), (20, 0)])]
    w = [(f, 1000 * f + 10 * a + n, a, a + n) for f in (1, 2, 3) for a in range(22) for n in (0, 1, 4)]
    scoped = spark.createDataFrame([*s, (1, 999, None, 4)], "file_id int, scope_id int, start bigint, end bigint")
    asked = spark.createDataFrame([*w, (1, 7, None, None)], "file_id int, window_id int, start bigint, end bigint")
    want = {(f, i): n for f, i, a, b in w if (n := sum(f == g and y > a and b > x for g, _, x, y in s))}
    got = scopes.overlap_counts(scoped, asked)
    assert {(r.file_id, r.window_id): r.n for r in got.collect()} == want


def test_symbols_outside_ranges_are_not_shuffled(spark):
    plan = more_queries.str10_symbols_outside_ranges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" not in plan
