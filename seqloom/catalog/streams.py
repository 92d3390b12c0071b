"""Streaming queries, each drained over the given events and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import query, with_sql
from seqloom.catalog.inputs import HIST, LISTENS, listens, table, wall_micros
from seqloom.operators import sequences
from seqloom.session import durable_path
from seqloom.streaming import jobs


def joined(col, sep=","):
    return F.array_join(F.col(col).cast("array<string>"), sep)


def event_stream(spark, sf):
    raw = jobs.stream_folder(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")
    return raw.select("event_id", F.col("user_id").alias("uid"), F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
                      wall_micros(F.col("ts")).alias("ts"), F.timestamp_micros(wall_micros(F.col("ts"))).alias("at"))


SLICES = 3
WINDOWS = f"""w AS MATERIALIZED (SELECT *, count(*) OVER x AS n, array_to_string(list(item_id) OVER x, ',') AS history
   FROM listens WINDOW x AS (PARTITION BY uid ORDER BY ts, event_id {HIST}))"""


@query("stream_longest_history", with_sql(LISTENS, WINDOWS, body="""
    SELECT uid, event_id, item_id, history FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, event_id) AS rn FROM w WHERE n > 0) WHERE rn = 1"""))
def stream_longest_history(spark, sf):
    samples = sequences.sliding_windows(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"]).select(
        "uid", "event_id", "item_id", sequences.history_of("item_id").alias("items"))
    stored = durable_path(spark, "samples")
    samples.repartition(4, "uid").write.parquet(stored)
    out, check = durable_path(spark, "changes"), durable_path(spark, "stream")
    running = jobs.longest_history(jobs.stream_folder(spark, stored, samples.schema, files_per_batch=2), "uid", "items", "event_id", ["item_id", "items"])
    jobs.drain_changes(running, out, check)
    best = jobs.latest(spark, out, "uid bigint, event_id bigint, item_id bigint, items array<bigint>", ["uid"])
    return best.select("uid", "event_id", "item_id", joined("items").alias("history"))


@query("stream_rolling_history", with_sql(LISTENS, WINDOWS, body="SELECT event_id, uid, item_id, ts, history FROM w WHERE n > 0"))
def stream_rolling_history(spark, sf):
    """The log as files in time order, one file a micro-batch."""
    log, out, state, check = (durable_path(spark, label) for label in ("log", "rolling", "state", "stream"))
    rows = listens(spark, sf).select("event_id", "uid", "item_id", "ts")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    for part in range(SLICES if low is not None else 0):
        cut = F.expr(f"(ts - {low}L) * {SLICES}L div ({high - low + 1}L)")
        rows.filter(cut == part).coalesce(1).write.mode("append").parquet(log)
    if low is None:
        return rows.withColumn("history", F.lit(""))
    jobs.drain_rolling_history(jobs.stream_folder(spark, log, rows.schema, files_per_batch=1), out, state, check)
    found = spark.read.schema("event_id bigint, uid bigint, item_id bigint, ts bigint, history array<bigint>, batch_id bigint").parquet(out)
    return found.drop("batch_id").withColumn("history", joined("history"))


@query("stream_degree_counts", with_sql(LISTENS, body="""
    SELECT 'item' AS side, item_id AS id, count(*) AS degree FROM listens GROUP BY 2 UNION ALL SELECT 'user', uid, count(*) FROM listens GROUP BY 2"""))
def stream_degree_counts(spark, sf):
    parts = []
    for side, col in (("item", "item_id"), ("user", "uid")):
        out, check = durable_path(spark, "degrees"), durable_path(spark, "stream")
        jobs.drain_changes(jobs.degree_counts(event_stream(spark, sf), col), out, check)
        counts = jobs.latest(spark, out, f"{col} bigint, degree bigint", [col])
        parts.append(counts.select(F.lit(side).alias("side"), F.col(col).alias("id"), "degree"))
    return parts[0].unionByName(parts[1])


# windows that the watermark (newest event minus one hour) has passed
@query("stream_daily_popularity", with_sql(LISTENS, "d AS (SELECT item_id, ts // 86400000000 AS day, count(*) AS n FROM listens GROUP BY 1, 2)", body="""
    SELECT day * 86400 AS start, item_id, n FROM d WHERE (day + 1) * 86400000000 <= (SELECT max(ts) - 3600000000 FROM listens)"""))
def stream_daily_popularity(spark, sf):
    out, check = durable_path(spark, "daily"), durable_path(spark, "stream")
    counted = jobs.windowed_popularity(event_stream(spark, sf), "at", "item_id")
    epoch = counted.select(F.unix_seconds("start").alias("start"), "item_id", "n")
    jobs.drain_rows(epoch, out, check)
    return spark.read.schema("start bigint, item_id bigint, n bigint").parquet(out)


