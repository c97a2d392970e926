"""A stored index equals one made anew, after every kind of change, after a cut-off update and behind a stream."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from envatlas.plans import stored
from envatlas.plans.workspace import Index

OLD, NEW = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 2, 1)
SCHEMA = "file_id bigint, path string, content string, mtime timestamp"
GLOBS = [".env", ".env.local"]
BEFORE = [
    (1, "src/app.js", "import { url } from './config';\nconst env = process.env;\nuse(env.HOST, url, process.env.PORT);\n", OLD),
    (2, "src/config.ts", "export const url = process.env.DB_URL;\n", OLD),
    (3, "src/old.py", "import os\nx = os.environ['GONE']\n", OLD),
    (4, ".env", "PORT=1\nDB_URL=u${PORT}\n", OLD),
    (5, ".env.local", "PORT=2\n", OLD),
    (6, "src/same.go", 'package m\nvar s = os.Getenv("SAME")\n', OLD),
]
AFTER = [
    BEFORE[0],
    (2, "src/config.ts", "const held = process.env.DB_HOST;\nexport const url = held;\n", NEW),
    (4, ".env", "PORT=3\nDB_HOST=h${PORT}\nBAD LINE\n", NEW),
    BEFORE[5],
    (7, "src/new.js", "function f() { const { TOKEN: t } = process.env; return t; }\n", OLD),
    (8, "notes.txt", None, OLD),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(index, answers=False):
    """All rows of all tables and, if asked for, of answers that join files."""
    tables = stored._tables(index)
    if answers:
        tables |= {"names": index.env_to_files, "values": index.values, "imported": index.imported, "diagnostics": index.diagnostics()}
    return {k: sorted(repr(sorted(r.asDict(True).items())) for r in t.collect()) for k, t in tables.items()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == b[k], k


def test_saved_and_refreshed(spark, tmp_path):
    path = str(tmp_path / "index")
    stored.save(Index(frame(spark, BEFORE), GLOBS), path, buckets=16)
    assert stored.refresh(spark, path, frame(spark, BEFORE)) == []
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "about" not in d}
    before = files()
    buckets = stored.refresh(spark, path, frame(spark, AFTER))
    assert 0 < len(buckets) <= 6
    assert {f for f in before - files()} == {f for f in before if int(f.split("bucket=")[1].split("/")[0]) in buckets}
    same(content(stored.load(spark, path), answers=True), content(Index(frame(spark, AFTER), GLOBS), answers=True))
    assert stored.refresh(spark, path, frame(spark, AFTER)) == []


def test_cut_off_update_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    stored.save(Index(frame(spark, BEFORE), GLOBS), path, buckets=2)
    put, done = stored._put, []

    def fails(rows, buckets, to, mode):
        if len(done) == 4:
            raise RuntimeError("lost")
        done.append(to)
        put(rows, buckets, to, mode)

    monkeypatch.setattr(stored, "_put", fails)
    with pytest.raises(RuntimeError):
        stored.refresh(spark, path, frame(spark, AFTER))
    monkeypatch.setattr(stored, "_put", put)
    assert stored.refresh(spark, path, frame(spark, AFTER))
    same(content(stored.load(spark, path)), content(Index(frame(spark, AFTER), GLOBS)))


def test_all_files_gone_and_empty(spark, tmp_path):
    path = str(tmp_path / "index")
    stored.save(Index(frame(spark, []), GLOBS), path, buckets=2)
    assert stored.load(spark, path).file_index().count() == 0
    assert stored.refresh(spark, path, frame(spark, BEFORE[:2]))
    assert {r.name for r in stored.load(spark, path).env_to_files.collect()} == {"PORT", "DB_URL"}  # HOST is read through an alias only
    assert stored.refresh(spark, path, frame(spark, []))
    assert all(not rows for rows in content(stored.load(spark, path)).values())


def test_followed(spark, tmp_path):
    """Two streams of edits, the second with a version older than the stored one, which is dropped."""
    path, day = str(tmp_path / "index"), datetime.timedelta(1)
    js = lambda name: f"use(process.env.{name});"
    edits = "path string, ts timestamp, op string, version bigint, content string"
    stored.save(Index(frame(spark, []), GLOBS), path, buckets=4)
    first = [("a.js", OLD, "open", 1, js("A1")), ("a.js", OLD + day, "change", 2, js("A2")), ("b.js", OLD, "open", 1, js("B1")), ("c.js", OLD, "open", 1, js("C1"))]
    second = [("a.js", OLD, "change", 1, js("A0")), ("b.js", NEW, "close", 2, None), ("c.js", OLD - day, "close", 0, None), ("d.js", NEW, "open", 1, js("D1"))]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, edits).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        stream = spark.readStream.schema(edits).parquet(str(tmp_path / f"in{i}"))
        assert stored.follow(stream, path, str(tmp_path / f"cp{i}")).awaitTermination(200)
        names = {r.name for r in stored.load(spark, path).env_to_files.collect()}
        assert names == ({"A2", "B1", "C1"} if i == 0 else {"A2", "C1", "D1"})
    again = spark.createDataFrame(second, edits).where(F.col("op") == "open")
    assert stored.apply_edits(spark, path, again) == []
