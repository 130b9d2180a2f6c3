"""The durable queue and the watched jobs, driven batch by batch."""

import datetime
import time
import uuid

from corpusloom.session import shared_dir
from corpusloom.streaming.queue import Queue
from corpusloom.streaming.watch import watched

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id string, kind string, queue string, at timestamp, seq long"


def events(spark, *rows):
    return spark.createDataFrame([(i, k, q, T0 + datetime.timedelta(minutes=m), m) for i, k, q, m in rows], SCHEMA)


def statuses(queue):
    return {r.id: r.status for r in queue.jobs().collect()}


def test_queue(spark):
    queue = Queue(spark, f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}")
    assert statuses(queue) == {}
    first = events(spark, ("a", "submit", "slow", 0), ("b", "submit", "slow", 1), ("c", "submit", "fast", 2), ("a", "submit", "fast", 3), ("d", "start", None, 4), (None, "submit", "fast", 5), ("e", "odd", "fast", 6))
    assert queue.apply(first, 0)
    assert statuses(queue) == {"a": "queued", "b": "queued", "c": "queued"}
    order = queue.waiting(["fast", "slow"]).collect()
    assert sorted((r.queue, r.place, r.id) for r in order) == [("fast", 1, "c"), ("slow", 1, "a"), ("slow", 2, "b")]
    version = queue.table.latest()
    assert not queue.apply(first, 0) and queue.table.latest() == version  # replayed: nothing changes
    second = events(spark, ("a", "start", None, 10), ("a", "cancel", None, 11), ("a", "finish", None, 12), ("b", "finish", None, 10), ("c", "start", None, 10), ("c", "finish", None, 13), ("c", "cancel", None, 14), ("f", "cancel", None, 10), ("f", "submit", "fast", 11))
    assert queue.apply(second, 1)
    assert statuses(queue) == {"a": "cancelled", "b": "queued", "c": "completed", "f": "queued"}
    assert queue.apply(events(spark, ("c", "submit", "fast", 20), ("b", "start", None, 20), ("b", "fail", None, 21)), 2)
    assert statuses(queue) == {"a": "cancelled", "b": "failed", "c": "completed", "f": "queued"}
    (b,) = queue.jobs().filter("id = 'b'").collect()
    assert (b.queue, b.seq) == ("slow", 1)


def test_stream_that_starts_again(spark, tmp_path):
    queue = Queue(spark, f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}")
    at, mark = str(tmp_path / "in"), str(tmp_path / "mark")

    def run(publish):
        stream = spark.readStream.schema(SCHEMA).parquet(at).writeStream.foreachBatch(publish).option("checkpointLocation", mark).trigger(availableNow=True).start()
        stream.awaitTermination(60)

    events(spark, ("a", "submit", "fast", 0), ("b", "submit", "fast", 1)).coalesce(1).write.parquet(at)

    def dies(rows, batch):
        queue.apply(rows, batch)
        raise RuntimeError("lost after the commit")

    try:
        run(dies)
    except Exception as e:  # noqa: BLE001
        assert "lost after the commit" in str(e)
    assert queue.table.latest() == 1
    run(queue.sink())  # the batch comes again
    assert queue.table.latest() == 1 and statuses(queue) == {"a": "queued", "b": "queued"}
    events(spark, ("a", "start", None, 5)).coalesce(1).write.mode("append").parquet(at)
    run(queue.sink())
    assert queue.table.latest() == 2 and statuses(queue) == {"a": "running", "b": "queued"}


def test_watched_jobs(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = "id string, status string, progress int, updated_at timestamp"
    at, name = str(tmp_path / "in"), f"watched_{uuid.uuid4().hex}"
    m = lambda i: T0 + datetime.timedelta(minutes=i)

    def add(*rows):
        spark.createDataFrame(list(rows), kinds).coalesce(1).write.mode("append").parquet(at)

    def seen(wanted, seconds=60):
        until = time.time() + seconds
        while time.time() < until:
            rows = [(r.id, r.event, r.progress) for r in spark.table(name).collect()]
            if wanted(rows):
                return rows
            time.sleep(0.3)
        raise AssertionError(rows)

    add(("1", "queued", 0, m(0)), ("1", "queued", 0, m(0)), ("2", "queued", None, m(0)), (None, "queued", 0, m(0)))
    stream = watched(spark.readStream.schema(kinds).parquet(at), heartbeat_seconds=2).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="200 milliseconds").start()
    try:
        rows = seen(lambda rows: sum(e == "heartbeat" for i, e, _ in rows if i == "1") >= 2)
        assert sorted(r for r in rows if r[1] != "heartbeat") == [("1", "queued", 0), ("2", "queued", None)]
        add(("1", "running", 15, m(2)), ("1", "running", 40, m(3)), ("1", "queued", 0, m(1)), ("2", "failed", 10, m(2)))
        rows = seen(lambda rows: ("1", "running", 40) in rows and ("2", "failed", 10) in rows)
        assert [r for r in rows if r[0] == "1" and r[1] not in ("heartbeat", "queued")] == [("1", "running", 15), ("1", "running", 40)]
        ended = sum(e == "heartbeat" for i, e, _ in rows if i == "2")
        add(("1", "running", 40, m(3)), ("2", "running", 50, m(9)), ("3", "queued", 1, m(9)))  # the same version, and one after the end
        rows = seen(lambda rows: ("1", "heartbeat", 40) in rows and ("3", "queued", 1) in rows)
        assert sum(e == "heartbeat" for i, e, _ in rows if i == "2") == ended
        assert ("2", "running", 50) not in rows and sum(r == ("1", "running", 40) for r in rows) == 1
    finally:
        stream.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
