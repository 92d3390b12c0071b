"""Structured Streaming forms of the running summaries and the rolling history.

Jobs read a folder of Parquet files and run until what is there is consumed. Running aggregates
are written as a change log, one idempotent folder per micro-batch, and compacted on read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.ranking import keep_first_per_key
from seqloom.operators.sequences import HISTORY, sliding_windows
from seqloom.session import discard, stored


def stream_folder(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def drain(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def drain_changes(df: DataFrame, out: str, checkpoint: str) -> None:
    """Run a running aggregate to the end; each micro-batch overwrites its own folder, so a retry changes nothing."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    drain(df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start())


def latest(spark: SparkSession, out: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Newest change per key."""
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def drain_rows(df: DataFrame, out: str, checkpoint: str) -> None:
    drain(df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out))


def longest_history(samples: DataFrame, user: str, history: str, seq: str, keep: Sequence[str]) -> DataFrame:
    """Running longest history per user; the earliest by `seq` among equals."""
    rank = F.struct(F.size(history).alias("len"), (-F.col(seq)).alias("first"))
    return samples.groupBy(user).agg(F.max_by(F.struct(seq, *keep), rank).alias("b")).select(user, "b.*")


def degree_counts(events: DataFrame, side: str) -> DataFrame:
    """Running number of rows per user or item, the counts core thresholds look at."""
    return events.groupBy(side).agg(F.count(F.lit(1)).alias("degree"))


def windowed_popularity(events: DataFrame, ts: str, item: str, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Item counts per tumbling window, emitted once the watermark has passed the window."""
    counted = events.withWatermark(ts, lateness).groupBy(F.window(ts, width), item).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), item, "n")


def drain_rolling_history(
    events: DataFrame, out: str, state: str, checkpoint: str, width: int = HISTORY, lateness_us: int = 3600 * 1_000_000,
    idle_us: int = 30 * 24 * 3600 * 1_000_000,
) -> None:
    """For each event (event_id, uid, item_id, ts bigint micros): the up to `width` items before it, written to `out`.

    A micro-batch is windowed by the same operator as a whole table, together with the last `width` rows of every user from the
    batches before, so no task holds a user's rows at once. Those rows are the state: one table per batch under `state`, bounded
    per user however active. Rows more than `lateness_us` behind the newest one of earlier batches are dropped, and a user's
    state goes when the user has been idle for `idle_us` of event time. Each batch overwrites its own folders, so a retry changes
    nothing; the trigger limits of the reader bound a batch.
    """
    columns = ["event_id", "uid", "item_id", "ts"]
    schema = "event_id bigint, uid bigint, item_id bigint, ts bigint"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*columns)
        if batch_id:
            past = spark.read.schema(schema).parquet(f"{state}/batch_id={batch_id - 1}")
            newest = past.agg(F.max("ts")).first()[0]
            if newest is not None:
                new = new.filter(F.col("ts") >= newest - lateness_us)
        else:
            past = new.limit(0)
        rows, path = stored(past.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True))), "rolling")
        windows = sliding_windows(rows, "uid", ["ts", "event_id"], ["item_id"], width).filter("fresh")
        windows.select("event_id", "uid", "item_id", "ts", F.col("history.item_id").alias("history")).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        last = keep_first_per_key(rows, ["uid"], [F.desc("ts"), F.desc("event_id")], width)
        horizon = (rows.agg(F.max("ts")).first()[0] or 0) - idle_us
        awake = rows.groupBy("uid").agg(F.max("ts").alias("at")).filter(F.col("at") >= horizon).select("uid")
        last.join(awake, "uid", "left_semi").select(*columns).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        discard(spark, path)
        if batch_id > 1:
            discard(spark, f"{state}/batch_id={batch_id - 2}")

    drain(events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start())
