"""Versioned partitions: a commit is seen whole or not at all."""

import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.commits import Versions
from corpusloom.session import shared_dir

SCHEMA = "id long, snapshot string"


def table(spark):
    return Versions(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", "snapshot")


def rows_of(t):
    return [(r.id, r.snapshot) for r in t.read().collect()]


def test_replacement(spark):
    t = table(spark)
    df = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    with pytest.raises(ValueError, match="no version"):
        t.read()
    assert t.replace(df((1, "a"), (2, "b"), (3, None)), ["a", "b", None]) == 1
    before = t.read()
    assert t.replace(df((9, "a")), ["a"]) == 2
    assert sorted(rows_of(t)) == [(2, "b"), (3, None), (9, "a")]
    assert {r.id for r in before.collect()} == {1, 2, 3}  # a reader keeps what it began with
    assert t.replace(df(), ["b"]) == 3  # a snapshot that has no rows any more
    assert {r.id for r in t.read().collect()} == {3, 9}
    assert {r.id for r in t.read(values=[None]).collect()} == {3}
    assert {r.id for r in t.read(1).collect()} == {1, 2, 3}
    with pytest.raises(ValueError, match="aren't replaced"):
        t.replace(df((5, "c")), ["a"])
    with pytest.raises(ValueError, match="other columns"):
        t.replace(spark.createDataFrame([("a", 1)], "snapshot string, n int"), ["a"])
    assert t.latest() == 3
    t.vacuum()
    assert {r.id for r in t.read().collect()} == {3, 9}


def test_failed_write_is_invisible(spark):
    t = table(spark)
    t.replace(spark.createDataFrame([(1, "a")], SCHEMA), ["a"])
    broken = spark.range(20).select("id", F.when(F.col("id") < 10, "a").otherwise(F.raise_error(F.lit("lost"))).alias("snapshot"))
    with pytest.raises(Exception, match="lost"):
        t.replace(broken, ["a"])
    assert t.latest() == 1 and rows_of(t) == [(1, "a")]


def test_two_writers(spark, monkeypatch):
    t = table(spark)
    other = Versions(spark, t.path, "snapshot")
    real = t._publish

    def late(number, version):  # another writer publishes the same number first
        monkeypatch.setattr(t, "_publish", real)
        other.replace(spark.createDataFrame([(2, "b")], SCHEMA), ["b"])
        return real(number, version)

    monkeypatch.setattr(t, "_publish", late)
    assert t.replace(spark.createDataFrame([(1, "a")], SCHEMA), ["a"]) == 2
    assert sorted(rows_of(t)) == [(1, "a"), (2, "b")]
