"""Session helpers: where durable intermediate tables live and how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings the jobs count on for hot join keys; adaptive execution splits what statistics cannot foresee.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
_LOCAL_ROOTS: dict[str, str] = {}


def setting(spark: SparkSession, key: str, default: int) -> int:
    """Integer session setting `seqloom.<key>` with a default."""
    return int(spark.conf.get(f"seqloom.{key}", str(default)))


def durable_root(spark: SparkSession) -> str:
    """Folder for tables that must outlive an executor.

    A cluster names a shared folder in `spark.checkpoint.dir`. Only a local master may
    fall back to a temporary folder, because there the driver and tasks share one disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if root:
        return f"{root.rstrip('/')}/seqloom/{app}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="seqloom-")
    return _LOCAL_ROOTS[app]


def durable_path(spark: SparkSession, label: str) -> str:
    return f"{durable_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` as Parquet in the shared folder and return a scan of it.

    Cuts lineage in loops and pins values that depend on task layout. Readers keep column
    pruning, and Catalyst gets the real size for its join choice.
    """
    path = durable_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str = "table", **metrics) -> tuple[DataFrame, dict]:
    """`materialize` that also returns the row count (`n`) seen by the write, in the same job."""
    seen = Observation(f"{label}-{uuid.uuid4().hex[:8]}")
    exprs = [F.count(F.lit(1)).alias("n")] + [c.alias(k) for k, c in metrics.items()]
    table = materialize(df.observe(seen, *exprs), label)
    return table, dict(seen.get)


def stored(df: DataFrame, label: str = "table") -> tuple[DataFrame, str]:
    """(table, path) of `df` written to the shared folder, for callers that `discard` it."""
    path = durable_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored_counted(df: DataFrame, label: str = "table") -> tuple[DataFrame, str, int]:
    """(table, path, row count) of `df` written to the shared folder, for loops that `discard` what they replaced."""
    path = durable_path(df.sparkSession, label)
    seen = Observation(f"{label}-{uuid.uuid4().hex[:8]}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, dict(seen.get)["n"]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def collect_small(df: DataFrame, bound: int, what: str) -> list:
    """Collect a result whose row count is bounded by a parameter, not by the data; refuse a surprise before it is here."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than the {bound} rows expected")
    return rows


def collect_arrow(df: DataFrame, bound: int, what: str):
    """`collect_small` as an Arrow table, for some ten thousand rows of numbers."""
    table = df.limit(bound + 1).toArrow()
    if table.num_rows > bound:
        raise ValueError(f"{what}: more than the {bound} rows expected")
    return table
