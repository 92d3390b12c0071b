"""Per-user ordered sequences and the sliding history windows cut from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.ranking import heavy_keys, position_in_key

HISTORY = 10
SLICE_ROWS = 100_000


def sliding_windows(
    df: DataFrame, user: str, order: Sequence[str], fields: Sequence[str],
    width: int = HISTORY, heavy_rows: int | None = None, slice_rows: int = SLICE_ROWS,
    counted: DataFrame | None = None, position: str | None = None,
) -> DataFrame:
    """For every row but a user's first: the up to `width` rows before it, oldest first.

    Adds `history`, an array of structs of `fields`. A user above the heavy-key limit is cut
    into slices; each slice borrows the last `width` rows before it, from as many slices as hold them. `counted` is a
    narrower table with the same rows per user to look for such users in. `position` names a column for the row's place among
    its user's rows, from 0; rows that tie share the first place.
    """
    past = F.collect_list(F.struct(*fields))
    heavy = heavy_keys(df if counted is None else counted, [user], heavy_rows)
    spec = Window.partitionBy(user).orderBy(*order).rowsBetween(-width, -1)
    place = {position: (F.rank().over(Window.partitionBy(user).orderBy(*order)) - 1).cast("bigint")} if position else {}
    if heavy is None:
        return df.withColumns({"history": past.over(spec), **place}).filter(F.size("history") > 0)
    light = df.join(heavy, user, "left_anti").withColumns({"history": past.over(spec), **place})
    placed = position_in_key(df.join(heavy, user, "left_semi"), [user], order, "__pos", heavy_rows)
    own = F.expr(f"__pos div {slice_rows}L")
    # a row is in its own slice and in every later one that begins within the next `width` rows
    sliced = placed.withColumn("__own", own).withColumn(
        "__slice", F.explode(F.sequence(own, F.expr(f"(__pos + {width}L) div {slice_rows}L"))))
    in_slice = Window.partitionBy(user, "__slice").orderBy("__pos").rowsBetween(-width, -1)
    spread = (
        sliced.withColumn("history", past.over(in_slice))
        .filter(F.col("__own") == F.col("__slice"))
        .withColumns({position: F.min("__pos").over(Window.partitionBy(user, *order))} if position else {})
        .drop("__pos", "__own", "__slice")
    )
    return light.unionByName(spread).filter(F.size("history") > 0)


def history_of(field: str, history: str = "history") -> Column:
    """One field of the history structs as a parallel array."""
    return F.col(f"{history}.{field}")


def window_columns(df: DataFrame, user: str, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Flatten windows to (user, history column, target column) pairs given as (field, history name, target name)."""
    cols = [F.col(user)]
    for field, history_name, target_name in pairs:
        cols += [history_of(field).alias(history_name), F.col(field).alias(target_name)]
    return df.select(*cols)


def user_sequences(
    df: DataFrame, user: str, order: Sequence[str], fields: Sequence[str],
    heavy_rows: int | None = None, segment_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Each user's rows in time order as arrays of structs, `sequence`, of `segment_rows` rows each.

    Positions alone decide the bigint `segment`, for users of every size, so no row holds more than one segment.
    """
    entry = F.struct(*order, *[f for f in fields if f not in order])
    ordered = F.sort_array(F.collect_list(entry)).alias("__seq")
    shaped = F.transform("__seq", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("sequence")
    placed = position_in_key(df, [user], order, "__pos", heavy_rows)
    split = placed.withColumn("segment", F.expr(f"__pos div {segment_rows}L"))
    return split.groupBy(user, "segment").agg(ordered).select(user, "segment", shaped)


def whole_sequences(segments: DataFrame, user: str, sequence: str = "sequence", *more: str) -> DataFrame:
    """One row per user from the rows of `user_sequences`, for formats that have no segments; the row is as long as the user's log."""
    names = (sequence, *more)
    parts = F.sort_array(F.collect_list(F.struct("segment", *names)))
    return segments.groupBy(user).agg(parts.alias("__parts")).select(user, *[F.flatten(F.col(f"__parts.{n}")).alias(n) for n in names])


def order_within_users(df: DataFrame, user: str, order: Sequence[str]) -> DataFrame:
    """Rows laid out by (user, time): a range sort, so a hot user may span several files."""
    return df.repartitionByRange(user, *order).sortWithinPartitions(user, *order)


def drop_short(df: DataFrame, sequence: str, user: str, least: int = 2) -> DataFrame:
    """Rows of users whose segments together hold at least `least` entries."""
    long_enough = df.groupBy(user).agg(F.sum(F.size(sequence)).alias("__n")).filter(F.col("__n") >= least).select(user)
    return df.join(long_enough, user, "left_semi")


def repeats_last(target: str, history: str) -> Column:
    """True when the target equals the newest history element; false for an empty history."""
    return F.when(F.size(history) > 0, F.col(target) == F.element_at(history, -1)).otherwise(F.lit(False))


def longest_history(df: DataFrame, user: str, history: str, seq: str, keep: Sequence[str]) -> DataFrame:
    """Per user the sample with the longest history; the earliest by `seq` wins a tie."""
    best = F.max_by(F.struct(seq, *keep), F.struct(F.size(history).alias("len"), (-F.col(seq)).alias("first")))
    return df.groupBy(user).agg(best.alias("__best")).select(user, "__best.*")


def item_frequency(df: DataFrame, items: str, item: str = "item") -> DataFrame:
    """Occurrences of every item: over sequences when the column holds arrays, else over the rows of a log."""
    listed = df.schema[items].dataType.typeName() == "array"
    return df.select((F.explode(items) if listed else F.col(items)).alias(item)).groupBy(item).agg(F.count(F.lit(1)).alias("freq"))


def length_histogram(df: DataFrame, length: Column, bins: int = 50, upper: float = 10000.0) -> DataFrame:
    """Counts per equal-width bin on [0, upper]; the last of them includes its upper edge, bin `bins` holds all above."""
    width = upper / bins
    rows = df.select(length.cast("double").alias("len"))
    inside = F.least(F.floor(F.col("len") / width), F.lit(bins - 1)).cast("bigint")
    bin_no = F.when(F.col("len") > upper, F.lit(bins).cast("bigint")).otherwise(inside)
    return rows.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
