"""What the Jaccard join carries when its sketch has far fewer cells than the texts have shingles, as at several GB."""

import random

import numpy as np

from envatlas.llm import jaccard_join


def test_unique_shingles_are_not_carried_when_the_sketch_is_full(spark):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(2000))) for i in range(150)]  # 300,000 shingles in 65,536 cells
    rows += [(1000 + i, rows[i][1] + " more") for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    sets = jaccard_join._sets(df, 4, 85, True, 16).collect()
    assert {x.id for x in sets if x.text is not None} >= {*range(5), *range(1000, 1005)}
    assert sum(len(x.prefix or ()) for x in sets) <= 6000  # of 46,000 in the sets' first places 3,000 are of the ten
    out = {x.id: x.component_id for x in jaccard_join.link(df, "id", bits=16).collect()}
    assert out == {i: i - 1000 if i >= 1000 else i for i, _ in rows}


def test_marks_differ_in_no_more_bits_than_sets_do():
    r = np.random.default_rng(3)
    for n, m, common in ((1, 1, 0), (1, 1, 1), (70, 60, 50), (500, 520, 480), (130, 127, 120), (3000, 2700, 2600), (64, 2000, 10)):
        x = r.integers(0, 2**63, n + m - common, dtype=np.uint64)
        a, b = x[:n], x[n - common :]
        assert jaccard_join._apart([jaccard_join._mark(a)], [jaccard_join._mark(b)])[0] <= n + m - 2 * common


def test_regions_of_the_same_sets_stay_once(spark):
    r = random.Random(7)
    rows = [(i, " ".join(f"v{r.randrange(10**6)}" for _ in range(400))) for i in range(60)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(40)] + [(2000 + i, rows[i][1] + " than that") for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    sets = jaccard_join._sets(df, 4, 85, True, 20).where("prefix is not null").dropDuplicates(["name"]).cache()
    members, place = {}, {}
    for x in sets.collect():
        for region, at in zip(x.prefix, x.places, strict=True):
            members.setdefault(region, set()).add(bytes(x.name))
            place[region, bytes(x.name)] = at
    held, first = {}, {}
    for x in jaccard_join._regions(sets).collect():
        held.setdefault(x.region, set()).add(bytes(x.name))
        assert place[x.region, bytes(x.name)] == x.place
    for region, some in held.items():
        assert some == members[region] and len(some) > 1
        assert frozenset(some) not in first  # one region for the same sets
        first[frozenset(some)] = region
    assert first.keys() == {frozenset(x) for x in members.values() if len(x) > 1}
    for region, some in members.items():
        if len(some) > 1:
            assert all(place[first[frozenset(some)], x] <= place[region, x] for x in some)  # the first in the order
    assert len(held) <= 200  # of some 2,000 regions
    out = {x.id: x.component_id for x in jaccard_join.link(df, "id", bits=20).collect()}
    assert out == {i: i % 1000 for i, _ in rows}
    sets.unpersist()


def test_a_group_of_far_copies_of_one_text_ends_soon(spark, monkeypatch):
    r = random.Random(11)
    base = [f"b{i}" for i in range(147)]
    rows = [(0, " ".join(base))]
    for i in range(1, 161):  # 1 to 5 words are others: sets of 4 and more of them link with nothing, though all share the rarer shingles
        text = list(base)
        for k in r.sample(range(147), 1 + i % 5):
            text[k] = f"x{i}_{k}"
        rows.append((i, " ".join(text[: 147 - i % 3])))
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, t in rows for w in [t.split()]}
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    saved = []

    def save(df, name, f=jaccard_join.save):
        out = f(df, name)
        saved.append((name, out.count() if name == "regions" else 0))
        return out

    monkeypatch.setattr(jaccard_join, "save", save)
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    out = {x.id: x.component_id for x in jaccard_join.link(df, "id", bits=20).collect()}
    assert out == least and 30 < len(set(least.values())) < 130
    assert saved[2][0] == "regions" and saved[2][1] <= 1200, saved


def test_sets_meet_where_one_of_them_is_home(spark):
    r = random.Random(13)
    rows = []
    for i in range(40):  # pairs of every size around the limit
        a = [f"c{i}_{k}" for k in range(r.randrange(5, 120))]
        b = a[r.randrange(0, 1 + len(a) // 8) :] + [f"d{i}_{k}" for k in range(r.randrange(0, 1 + len(a) // 10))]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    sets = {i: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} for i, t in rows for w in [t.split()]}
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(4)
    for percent in (70, 85, 95, 100):
        out = {x.id: x.component_id for x in jaccard_join.link(df, "id", percent=percent, bits=20).collect()}
        assert out == {i: i - i % 2 if 100 * len(sets[i] & sets[i ^ 1]) >= percent * len(sets[i] | sets[i ^ 1]) else i for i in sets}
