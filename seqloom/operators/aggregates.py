"""Grouped summaries: popularity, last-wins dictionaries, code collisions, text statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.text import word_count
from seqloom.operators.ranking import heavy_keys, position_in_key

PROPENSITY_POWER = 0.05  # fixed value


def propensity(catalogue: DataFrame, events: DataFrame, item: str) -> DataFrame:
    """Popularity of every catalogue item and ((freq + 1) / sum(freq + 1)) ^ 0.05, unseen items included."""
    freq = events.groupBy(item).agg(F.count(F.lit(1)).alias("freq"))
    known = catalogue.select(item).join(freq, item, "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    total = known.agg(F.sum(F.col("freq") + 1).alias("__total")).first()["__total"] or 1
    return known.withColumn("propensity", F.pow((F.col("freq") + 1) / F.lit(float(total)), F.lit(PROPENSITY_POWER)))


def last_wins(df: DataFrame, key: str, seq: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key holding the values of its last row by `seq` (partial aggregation, no sort)."""
    last = F.max_by(F.struct(*values), F.struct(*seq))
    return df.groupBy(key).agg(last.alias("__last")).select(key, "__last.*")


def vocabulary(df: DataFrame, tokens: str) -> DataFrame:
    """Distinct tokens in sorted order."""
    return df.select(F.explode(tokens).alias("token")).distinct().orderBy("token")


def words_per_record(df: DataFrame, text: str) -> DataFrame:
    counts = df.agg(F.sum(word_count(text)).alias("words"), F.count(F.lit(1)).alias("records"))
    return counts.withColumn("mean_words", F.col("words") / F.col("records"))


def words_per_user(df: DataFrame, user: str, text: str) -> DataFrame:
    """All words divided by the number of users."""
    counts = df.agg(F.sum(word_count(text)).alias("words"), F.countDistinct(user).alias("users"))
    return counts.withColumn("mean_words", F.col("words") / F.col("users"))


def split_summary(df: DataFrame, user: str, item: str, split: str) -> DataFrame:
    """Rows, users and items per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct(user).alias("users"),
        F.countDistinct(item).alias("items"))


def path_sizes(df: DataFrame, codes: str) -> DataFrame:
    return df.groupBy(codes).agg(F.count(F.lit(1)).alias("members"))


def collision_report(df: DataFrame, codes: str) -> DataFrame:
    """Items, distinct paths, collision rate, and how the collided groups look, from one row per path."""
    sizes = path_sizes(df, codes)
    return sizes.agg(
        F.sum("members").alias("items"), F.count(F.lit(1)).alias("paths"),
        F.sum((F.col("members") > 1).cast("bigint")).alias("collided_paths"),
        F.sum(F.col("members") - 1).alias("surplus"), F.max("members").alias("largest"),
    ).withColumn("collision_rate", 1 - F.col("paths") / F.col("items")
    ).withColumn("all_unique", F.col("surplus") == 0)


def codes_per_level(df: DataFrame, codes: str) -> DataFrame:
    """Distinct codes in use at every level, and their group sizes."""
    used = df.select(F.posexplode(codes).alias("level", "code")).groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))
    return used.groupBy("level").agg(
        F.count(F.lit(1)).alias("unique_codes"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
        F.avg("n").alias("mean_size"))


def collided_members(df: DataFrame, item: str, codes: str) -> DataFrame:
    """Members of every collided path as rows, with the group size: no group is gathered into one cell."""
    sizes = path_sizes(df, codes).filter(F.col("members") > 1)
    return df.select(item, codes).join(sizes, codes)


def suffix_collisions(df: DataFrame, item: str, codes: str, heavy_rows: int | None = None) -> DataFrame:
    """Append the 1-based ordinal (by item) as an extra level wherever a path occurs more than once.

    Ordinary paths are sized and numbered in one shuffle; paths above the heavy-key limit are
    numbered by ranges.
    """
    heavy = heavy_keys(df, [codes], heavy_rows)
    same = Window.partitionBy(codes)

    def numbered(rows: DataFrame, place: Column, shared: Column) -> DataFrame:
        return rows.withColumn(codes, F.when(shared, F.concat(codes, F.array(place.cast("int")))).otherwise(F.col(codes)))

    def light(rows: DataFrame) -> DataFrame:
        sized = rows.withColumn("__n", F.count(F.lit(1)).over(same)).withColumn("__at", F.row_number().over(same.orderBy(item)))
        return numbered(sized, F.col("__at"), F.col("__n") > 1).drop("__n", "__at")

    if heavy is None:
        return light(df)
    placed = position_in_key(df.join(heavy, codes, "left_semi"), [codes], [item], "__at", heavy_rows)
    spread = numbered(placed, F.col("__at") + 1, F.lit(True)).drop("__at")
    return light(df.join(heavy, codes, "left_anti")).unionByName(spread)


def per_level_code_sizes(df: DataFrame, code: Column) -> DataFrame:
    """Smallest, largest and mean cluster size."""
    return df.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("clusters"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
        F.avg("n").alias("mean_size"))
