"""Streams over several micro-batches must end where the batch job ends."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import sequences
from seqloom.session import durable_path
from seqloom.streaming import jobs

SCHEMA = "event_id bigint, uid bigint, item_id bigint, ts bigint, at timestamp"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Five files in time order; user 0 holds a third of the events."""
    path = str(tmp_path_factory.mktemp("stream"))
    events = spark.range(600).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).cast("bigint").alias("uid"),
        (F.col("id") * 11 % 23).alias("item_id"), ((F.col("id") + 200) * 600_000_000).alias("ts"),
        F.timestamp_micros((F.col("id") + 200) * 600_000_000).alias("at"))
    for n in range(5):
        events.filter(F.expr(f"event_id div 120 = {n}")).coalesce(1).write.mode("append").parquet(path)
    return path, events


def rolled(spark, path, **options):
    out = durable_path(spark, "rolling")
    jobs.drain_rolling_history(jobs.stream_folder(spark, path, SCHEMA, 1), out, durable_path(spark, "state"), durable_path(spark, "check"), **options)
    return sorted((r["event_id"], tuple(r["history"])) for r in spark.read.parquet(out).collect())


def test_rolling_history(spark, files):
    path, events = files
    w = sequences.sliding_windows(events, "uid", ["ts", "event_id"], ["item_id"])
    assert rolled(spark, path) == sorted((r["event_id"], tuple(h["item_id"] for h in r["history"])) for r in w.collect())


def test_late_rows_and_idle_users(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "event_id bigint, uid bigint, item_id bigint, ts bigint").coalesce(1).write.mode("append").parquet(str(tmp_path))

    write([(1, 1, 10, 0), (2, 2, 20, 100)])
    write([(3, 1, 11, 130), (4, 2, 21, 40), (5, 2, 22, 95), (11, 4, 40, 150)])  # 4 is too late, 5 is late but within bounds
    write([(6, 1, 12, 1200), (7, 2, 23, 1300), (8, 3, 30, 1300)])  # by now user 4 has been idle too long
    write([(9, 1, 13, 1301), (10, 2, 24, 1302), (12, 4, 41, 1302)])
    got = rolled(spark, str(tmp_path), width=2, lateness_us=10, idle_us=1100)
    assert got == [(3, (10,)), (6, (10, 11)), (7, (22, 20)), (9, (11, 12)), (10, (20, 23))]


def test_running_counts_and_longest(spark, files):
    path, events = files
    out = durable_path(spark, "degrees")
    jobs.drain_changes(jobs.degree_counts(jobs.stream_folder(spark, path, SCHEMA, 2), "uid"), out, durable_path(spark, "check"))
    got = {r["uid"]: r["degree"] for r in jobs.latest(spark, out, "uid bigint, degree bigint", ["uid"]).collect()}
    assert got == {r["uid"]: r["count"] for r in events.groupBy("uid").count().collect()}


def test_closed_windows_only(spark, files):
    path, events = files
    out = durable_path(spark, "daily")
    counted = jobs.windowed_popularity(jobs.stream_folder(spark, path, SCHEMA, 1), "at", "item_id")
    jobs.drain_rows(counted, out, durable_path(spark, "check"))
    got = {(r["start"], r["item_id"]): r["n"] for r in spark.read.parquet(out).collect()}
    want = events.groupBy(F.window("at", "1 day").alias("w"), "item_id").count()
    limit = events.agg(F.max("at") - F.expr("interval 1 hour")).first()[0]
    assert got == {(r["w"]["start"], r["item_id"]): r["count"] for r in want.collect() if r["w"]["end"] <= limit}
