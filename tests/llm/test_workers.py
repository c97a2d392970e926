"""What worker processes keep from task to task, and rounds that tell that they are the last."""

from functools import lru_cache

from envatlas.llm import alignment, bpe, shared


def test_a_worker_that_goes_on_to_other_work_forgets_vocabularies(monkeypatch):
    monkeypatch.setattr(shared, "_kept", [])
    cache = shared.kept(lru_cache(1)(lambda: object()))
    x = cache()
    assert list(shared.tidy(iter, cache)(iter([1]))) == [1]
    assert cache() is x
    list(shared.tidy(iter)(iter([])))
    assert cache.cache_info().currsize == 0


def test_vocabularies_are_among_what_is_forgotten():
    assert bpe._load in shared._kept
    assert alignment._load in shared._kept


def test_a_star_takes_one_round(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(shared, "save", lambda df, name, f=shared.save: (saved.append(name), f(df, name))[1])
    got = {r.node: r.component for r in shared.components(spark.createDataFrame([(7, i) for i in range(12) if i != 7], "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(12), 0)
    assert len(saved) == 2
