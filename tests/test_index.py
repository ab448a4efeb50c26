"""The vector index on files: removals, additions, failures and two writers."""

import re
from pathlib import Path

import pytest

from strataloom.sources import index as at
from strataloom.sources.index import VectorIndex


def rows(spark, ids, kind="long"):
    return spark.createDataFrame([(i, [float(len(str(i)))]) for i in ids], f"id {kind}, embedding array<double>")


def left(index):
    return sorted((r["id"] for r in index.read().collect()), key=str)


def files(path, what="rows-"):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if what in str(p)}


def test_removals_leave_the_vectors_as_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(at, "CHUNK", 128)
    index = VectorIndex(spark, str(tmp_path))
    assert not index.exists()
    index.add(rows(spark, range(3000)))
    before = files(tmp_path)
    index.remove(rows(spark, range(0, 3000, 3))).remove(rows(spark, [1, 1, 2999, 5000, -7, None]))
    assert left(index) == sorted((i for i in range(3000) if i % 3 and i not in (1, 2999)), key=str)
    assert files(tmp_path) == before
    monkeypatch.setattr(at, "BROADCAST", 0)  # by a shuffle
    assert left(index) == left(VectorIndex(spark, str(tmp_path))) == sorted((i for i in range(3000) if i % 3 and i not in (1, 2999)), key=str)


def test_only_ranges_that_may_hold_the_ids_are_read(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path)).add(rows(spark, range(800)))
    name = index.manifest.latest()[1][0]
    plan = index._hits(name, rows(spark, [799]).select("id"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+ (=|IN)", plan), plan
    assert len(index._hits(name, rows(spark, [799]).select("id")).select("part").distinct().collect()) == 1
    assert index._hits(name, rows(spark, [-1]).select("id")) is None


def test_texts_repeats_nulls_and_additions(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path)).add(rows(spark, ["a", "a", "b-1", None, ""], "string"))
    index.remove(rows(spark, ["a", ""], "string"))
    assert left(index) == [None, "b-1"] or left(index) == ["b-1", None]
    index.add(rows(spark, ["a", "c"], "string"))
    assert [i for i in left(index) if i] == ["a", "b-1", "c"]
    index.remove(rows(spark, ["a"], "string"))
    assert [i for i in left(index) if i] == ["b-1", "c"]
    empty = VectorIndex(spark, str(tmp_path / "empty")).add(rows(spark, []))
    assert left(empty.remove(rows(spark, [1]))) == [] and empty.exists()


def test_a_failed_and_an_overtaken_removal(spark, tmp_path, monkeypatch):
    index = VectorIndex(spark, str(tmp_path)).add(rows(spark, range(100)))
    real = at._Manifest.commit

    def fails(self, version, parts):
        raise OSError("stopped")

    monkeypatch.setattr(at._Manifest, "commit", fails)
    with pytest.raises(OSError):
        index.remove(rows(spark, [1]))
    assert len(left(index)) == 100
    state = []

    def overtaken(self, version, parts):
        if not state:  # another writer is done first
            state.append(1)
            VectorIndex(spark, str(tmp_path)).remove(rows(spark, [2]))
        return real(self, version, parts)

    monkeypatch.setattr(at._Manifest, "commit", overtaken)
    index.remove(rows(spark, [3]))
    assert set(range(100)) - set(left(index)) == {2, 3}
