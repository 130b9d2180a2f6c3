"""Streaming operators, driven batch by batch."""

import datetime

from pyspark.sql import functions as F

from corpusloom.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)


def rows_of(spark, tmp_path, batches, schema, apply, mode="append"):
    at = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(at)
    name = f"out_{abs(hash(at))}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    q = apply(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return [tuple(r) for r in spark.table(name).collect()]


def test_status_changes(spark, tmp_path):
    m = lambda i: T0 + datetime.timedelta(minutes=i)
    first = [(1, "queued", m(0)), (1, "queued", m(1)), (1, "running", m(2)), (2, "queued", m(0)), (None, "queued", m(0))]
    second = [(1, "failed", m(3)), (2, "queued", m(5)), (2, "running", m(6))]
    third = [(1, "running", m(9)), (2, None, m(9)), (2, "running", m(7))]
    found = rows_of(spark, tmp_path, [first, second, third], "id long, status string, updated_at timestamp", jobs.status_changes)
    assert sorted((i, s) for i, s, _ in found) == [(1, "failed"), (1, "queued"), (1, "running"), (2, "queued"), (2, "running")]


def test_finished_state_goes(spark, tmp_path):
    h = lambda i: T0 + datetime.timedelta(hours=i)
    batches = [[(1, "failed", h(0))], [(1, "queued", h(1))], [(2, "queued", h(30))], [(3, "queued", h(60))], [(1, "queued", h(61))], [(2, "queued", h(62))]]
    found = rows_of(spark, tmp_path, batches, "id long, status string, updated_at timestamp", lambda s: jobs.status_changes(s, 2))
    assert sorted((i, s) for i, s, _ in found) == [(1, "failed"), (1, "queued"), (2, "queued"), (3, "queued")]


def test_once(spark, tmp_path):
    found = rows_of(spark, tmp_path, [[("a", T0), ("b", T0)], [("a", T0), ("c", T0)]], "job string, ts timestamp", lambda s: jobs.once(s, "job", "ts").select("job"))
    assert sorted(found) == [("a",), ("b",), ("c",)]


def test_counts(spark, tmp_path):
    data = [[("a", T0), ("a", T0 + datetime.timedelta(minutes=1)), ("b", T0 + datetime.timedelta(minutes=7))]]
    found = rows_of(spark, tmp_path, data, "kind string, ts timestamp", lambda s: jobs.counts(s, "ts", "5 minutes", "kind").select("kind", "n", F.minute("start")), "complete")
    assert sorted(found) == [("a", 2, 0), ("b", 1, 5)]
