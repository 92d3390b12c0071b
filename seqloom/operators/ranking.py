"""Exact global and per-key ranks that never put a whole table or a whole hot key in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.hashing import portable_hash
from seqloom.session import materialize, setting

PART = "__part"
HEAVY_KEY_ROWS = 2_000_000
HISTOGRAM_BUCKETS = 4096
DRIVER_ROWS = 20_000
QUANTILE_ACCURACY, QUANTILE_MARGIN = 10_000, 3e-4


def _ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition on a total order and pin each row's partition number.

    The written table keeps the number stable when a lost executor forces a re-read.
    """
    return materialize(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "ranged")


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """0-based rank in the total order `order`."""
    return counted_rank(df, order, name)[0]


def counted_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> tuple[DataFrame, int]:
    """(ranked rows, row count).

    Ranges split ties of the leading columns, so a hot value spreads over tasks. Only one
    count per range reaches the driver.
    """
    spark = df.sparkSession
    ranged = _ranged(df, order)
    sizes = sorted((r[PART], r["count"]) for r in ranged.groupBy(PART).count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("bigint")).limit(0), 0
    base = spark.createDataFrame(offsets, f"{PART} int, __base bigint")
    local = F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1
    ranked = (
        ranged.withColumn("__local", local)
        .join(base, PART)
        .withColumn(name, (F.col("__local") + F.col("__base")).cast("bigint"))
        .drop(PART, "__local", "__base")
    )
    return ranked, total


def heavy_keys(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys with more rows than one task should sort, or None when there are none."""
    limit = limit or setting(df.sparkSession, "heavyKeyRows", HEAVY_KEY_ROWS)
    heavy = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    return None if heavy.isEmpty() else materialize(heavy, "heavy-keys")


def position_in_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", limit: int | None = None
) -> DataFrame:
    """0-based position of each row inside its key, by a total order within the key.

    Ordinary keys use one window. Keys above the limit are range-partitioned on (key, order),
    ranked inside each range and shifted by what earlier ranges hold of the same key.
    """
    heavy = heavy_keys(df, keys, limit)
    local = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint")
    if heavy is None:
        return df.withColumn(name, local)
    light = df.join(heavy, list(keys), "left_anti").withColumn(name, local)
    return light.unionByName(_spread_position(df.join(heavy, list(keys), "left_semi"), keys, order, name))


def _spread_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    ranged = _ranged(df, [*keys, *order])
    held = ranged.groupBy(PART, *keys).count()
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    base = held.select(PART, *keys, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(*order)) - 1
    return (
        ranged.withColumn("__local", local)
        .join(base, [PART, *keys])
        .withColumn(name, (F.col("__local") + F.col("__base")).cast("bigint"))
        .drop(PART, "__local", "__base")
    )


def cut_rows(
    df: DataFrame, order: Sequence[str], ranks: Callable[[int], Sequence[int]], small: int = DRIVER_ROWS
) -> tuple[int, list[tuple | None]]:
    """(row count, order values of the rows at the wanted 0-based ranks); `order[0]` is an integer column.

    `ranks` maps the row count to the ranks. A histogram of the leading column narrows each
    rank to one bucket, again and again until the bucket holds at most `small` rows, which
    are compared on the driver. Only a value that is itself repeated more often than that has
    its tied rows ranked, by ranges. Whatever the distribution, no task sorts the table.
    Rows without a leading value come first, and no cut falls among them.
    """
    lead, keys = order[0], df.select(*order)
    lo, hi, valued, n = keys.agg(F.min(lead), F.max(lead), F.count(lead), F.count(F.lit(1))).first()
    first = n - valued
    wanted = [max(r, first) for r in ranks(n)]
    open_ranges = {}
    if valued:
        open_ranges[(int(lo), int(hi), first, valued)] = sorted({r for r in wanted if r < n})
    ready: dict[tuple[int, int, int, int], list[int]] = {}
    found: dict[int, tuple] = {}
    while open_ranges:
        (a, b, below, size), group = open_ranges.popitem()
        if size <= small:
            ready[(a, b, below, size)] = group
        elif a == b:
            tied = global_rank(keys.filter(F.col(lead) == a), order, "__r")
            for r in tied.filter(F.col("__r").isin([g - below for g in group])).collect():
                found[r["__r"] + below] = tuple(r[c] for c in order)
        else:
            open_ranges.update(_narrow(keys, lead, a, b, below, group))
    if ready:
        spans = F.lit(False)
        for a, b, _, _ in ready:
            spans = spans | F.col(lead).between(a, b)
        rows = sorted(tuple(r) for r in keys.filter(spans).collect())
        for (a, b, below, _), group in ready.items():
            here = [r for r in rows if a <= r[0] <= b]
            found.update({g: here[g - below] for g in group})
    return n, [found.get(r) for r in wanted]


def _narrow(keys: DataFrame, lead: str, a: int, b: int, below: int, group: Sequence[int]) -> dict:
    """Buckets of [a, b] that hold one of the ranks, with the rows before each bucket."""
    width = (b - a) // HISTOGRAM_BUCKETS + 1
    bucket = F.expr(f"(`{lead}` - {a}L) div {width}L").alias("b")
    counts = keys.filter(F.col(lead).between(a, b)).groupBy(bucket).count().collect()
    out, seen = {}, below
    for number, size in sorted((r["b"], r["count"]) for r in counts):
        here = [r for r in group if seen <= r < seen + size]
        if here:
            start = a + number * width
            out[(start, min(start + width - 1, b), seen, size)] = here
        seen += size
    return out


def values_at(df: DataFrame, column: str, ranks: Callable[[int], Sequence[int]], small: int = DRIVER_ROWS) -> list[float]:
    """The values of a finite double column at the wanted 0-based ranks; nulls do not count.

    Approximate quantiles on both sides of the wanted ranks, then exact counts between them, narrow the rows down to a small
    share, again and again, until at most `small` are left to be compared on the driver. No task sorts or holds the column.
    """
    rows = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    lo, hi, n = rows.agg(F.min("x"), F.max("x"), F.count(F.lit(1))).first()
    wanted = [r for r in ranks(n) if 0 <= r < n] if n else []
    found: dict[int, float] = {}
    open_ranges = {(lo, hi, 0, n): sorted(set(wanted))} if wanted else {}
    while open_ranges:
        (a, b, below, size), group = open_ranges.popitem()
        inside = rows.filter(F.col("x").between(a, b))
        if a == b:
            found.update(dict.fromkeys(group, a))
            continue
        if size <= small:
            values = sorted(r["x"] for r in inside.collect())
            found.update({g: values[g - below] for g in group})
            continue
        sides = [max(0.0, (group[0] - below) / size - QUANTILE_MARGIN), min(1.0, (group[-1] + 1 - below) / size + QUANTILE_MARGIN)]
        left, right = inside.agg(F.percentile_approx("x", sides, QUANTILE_ACCURACY)).first()[0]
        inner = F.col("x").between(left, right)
        if left == a and right == b:  # few distinct values: at least the outermost ones split off
            inner = (F.col("x") > a) & (F.col("x") < b)
        piece = F.when(inner, 1).otherwise(F.when(F.col("x") <= left, 0).otherwise(2)).alias("piece")
        counts = inside.groupBy(piece).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(counts, key=lambda r: r["piece"]):
            here = [g for g in group if below <= g < below + r["n"]]
            if here:
                open_ranges[r["lo"], r["hi"], below, r["n"]] = here
            below += r["n"]
    return [found[r] for r in wanted]


def before(order: Sequence[str], cut: tuple | None, schema) -> Column:
    """True for rows that sort before the cut row, nulls first; all rows when there is no cut row."""
    if cut is None:
        return F.lit(True)
    here, smaller = F.lit(False), F.lit(True)
    for name, value in zip(order, cut):
        literal = F.lit(value).cast(schema[name].dataType)
        here = here | (smaller & (F.col(name) < literal))
        smaller = smaller & (F.col(name) == literal)
    return F.coalesce(here, F.lit(True))


def split_cuts(keys: DataFrame, order: Sequence[str], fractions: Sequence[float] = (0.8, 0.9)) -> list[tuple | None]:
    """The rows at int(f·N) of the time order, one per fraction."""
    return cut_rows(keys, order, lambda n: [int(n * f) for f in fractions])[1]


def label_splits(
    df: DataFrame, order: Sequence[str], cuts: Sequence[tuple | None],
    names: Sequence[str] = ("train", "valid", "test"), split: str = "split",
) -> DataFrame:
    """Name each row's split by comparing it with the cut rows."""
    label = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, cuts))):
        label = F.when(before(order, cut, df.schema), F.lit(name)).otherwise(label)
    return df.withColumn(split, label)


def chronological_split(df: DataFrame, order: Sequence[str], fractions: Sequence[float] = (0.8, 0.9)) -> DataFrame:
    """Label rows train, valid or test: the first int(f·N) rows by time come before each cut.

    Finds the cut rows only, so nothing is sorted or moved. `df` is read once per pass and
    should be a stored table.
    """
    return label_splits(df, order, split_cuts(df, order, fractions))


def contiguous_shards(df: DataFrame, order: Sequence[str], shards: int, name: str = "shard") -> DataFrame:
    """Shard i holds global ranks [i·N//n, (i+1)·N//n)."""
    ranked, total = counted_rank(df, order, "row")
    return ranked.withColumn(name, F.expr(f"((row + 1) * {shards}L - 1) div {max(total, 1)}L"))


def dense_ids(keys: DataFrame, order: Sequence[str], name: str = "idx") -> DataFrame:
    """Number distinct keys 0..n-1 in the given order."""
    return global_rank(keys, order, name)


def first_appearance(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key with the order values of its first row (partial aggregation, no window)."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    return first.select(key, *[F.col(f"__first.{c}").alias(f"first_{c}") for c in order])


def user_ids_by_appearance(df: DataFrame, user: str, order: Sequence[str]) -> DataFrame:
    firsts = first_appearance(df, user, order)
    return dense_ids(firsts, [f"first_{c}" for c in order], "user_idx").select(user, "user_idx")


def item_ids_by_appearance(df: DataFrame, user: str, item: str, order: Sequence[str]) -> DataFrame:
    """Items numbered as met when users are walked in their own id order, each in time order.

    Each (user, item) pair is reduced to its first event before user ids are joined on.
    """
    users = user_ids_by_appearance(df, user, order)
    met = [f"first_{c}" for c in order]
    pairs = df.groupBy(user, item).agg(F.min(F.struct(*order)).alias("__first")).select(
        user, F.col(item).alias("__item"), *[F.col(f"__first.{c}").alias(m) for c, m in zip(order, met)])
    firsts = first_appearance(pairs.join(users, user), "__item", ["user_idx", *met])
    ranked = dense_ids(firsts, [f"first_{c}" for c in ["user_idx", *met]], "item_idx")
    return ranked.select(F.col("__item").alias(item), "item_idx")


def ids_by_key(df: DataFrame, key: str, name: str, as_text: bool = False) -> DataFrame:
    """Numbered in sorted key order; text order when the keys are compared as strings."""
    keys = df.select(key).distinct()
    if not as_text:
        return dense_ids(keys, [key], name)
    return dense_ids(keys.withColumn("__text", F.col(key).cast("string")), ["__text"], name).drop("__text")


def ids_by_shuffle(df: DataFrame, key: str, name: str, seed: int = 42) -> DataFrame:
    keys = df.select(key).distinct().withColumn("__h", portable_hash(key, seed=seed))
    return dense_ids(keys, ["__h", key], name).drop("__h")


def keep_first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int
) -> DataFrame:
    """First n rows per key. Spark trims each map task to n rows per key before the shuffle."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rn") <= n).drop("__rn")
