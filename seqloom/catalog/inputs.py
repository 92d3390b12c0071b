"""The given tables in the shapes the operators take, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import sids

PURCHASE_ORDER = ["ts", "order_id", "line_no", "item_id", "supp_id", "rating"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def listens(spark: SparkSession, sf: str) -> DataFrame:
    item = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("uid"), item.alias("item_id"),
        wall_micros(F.col("ts")).alias("ts"), "event_type", "value")


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.floor(wall_micros(F.col("o_orderdate")) / 1000000).alias("ts"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id"),
        F.col("l_linenumber").cast("bigint").alias("line_no"), F.col("l_suppkey").alias("supp_id"),
        F.col("l_quantity").alias("rating"))
    return lines.join(orders, "order_id")


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Items with a three-level code taken from brand number, type and size."""
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("p_type")).cast("int")
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"), F.array(brand, kind, F.col("p_size").cast("int")).alias("codes"))
    return parts.withColumn("tokens", sids.tokens("codes", 0)).withColumn("sid", sids.sid("tokens"))


def item_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages as item metadata: the page title is the item title."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, sf, "pages").select("page_id", title.alias("title"), "html", "url")


LISTENS = """listens AS MATERIALIZED (
  SELECT event_id, user_id AS uid, CAST(regexp_extract(props, '\\d+') AS BIGINT) AS item_id,
         epoch_us(ts) AS ts, event_type, value FROM events)"""
PURCHASES = """purchases AS MATERIALIZED (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
         l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_no, l_suppkey AS supp_id,
         l_quantity AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CATALOGUE = """catalogue AS MATERIALIZED (
  SELECT *, '<a_' || c1 || '><b_' || c2 || '><c_' || c3 || '>' AS sid FROM (
    SELECT p_partkey AS item_id, p_name AS title, p_brand AS brand, p_type AS category,
           CAST(regexp_extract(p_brand, '\\d+') AS BIGINT) AS c1,
           CAST(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) AS BIGINT) AS c2,
           CAST(p_size AS BIGINT) AS c3 FROM part))"""
ITEM_META = """item_meta AS MATERIALIZED (
  SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, html, url FROM pages)"""
HIST = "ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING"
ROUND_ORDER = "ts, order_id, line_no, item_id, supp_id, rating"


def core_ctes(source: str, user: str, item: str, user_k: int, item_k: int, rounds: int,
              items_first: bool = False, out: str = "core", prefix: str = "cr") -> list[str]:
    """k-core unrolled for a fixed number of rounds, as SQL."""
    ctes, prev = [], source
    for r in range(rounds):
        name = out if r == rounds - 1 else f"{prefix}{r}"
        kept = f"SELECT * FROM {prev} WHERE {item} IN (SELECT {item} FROM {prev} GROUP BY 1 HAVING count(*) >= {item_k})"
        if items_first:
            ctes.append(f"{prefix}{r}_i AS MATERIALIZED ({kept})")
            ctes.append(f"{name} AS MATERIALIZED (SELECT * FROM {prefix}{r}_i WHERE {user} IN "
                        f"(SELECT {user} FROM {prefix}{r}_i GROUP BY 1 HAVING count(*) >= {user_k}))")
        else:
            ctes.append(f"{name} AS MATERIALIZED ({kept} AND {user} IN "
                        f"(SELECT {user} FROM {prev} GROUP BY 1 HAVING count(*) >= {user_k}))")
        prev = name
    return ctes
