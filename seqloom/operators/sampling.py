"""Seeded shuffles and samples that come out the same however the data is partitioned."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ranking import before, cut_rows, global_rank, portable_hash
from seqloom.session import materialize


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in seeded pseudo-random order; `keys` must identify a row."""
    return df.withColumn("__h", portable_hash(*keys, seed=seed)).orderBy("__h", *keys).drop("__h")


def shuffle_rank(df: DataFrame, keys: Sequence[str], seed: int = 42, name: str = "rank") -> DataFrame:
    hashed = df.withColumn("__h", portable_hash(*keys, seed=seed))
    return global_rank(hashed, ["__h", *keys], name).drop("__h")


def _cut(df: DataFrame, keys: Sequence[str], seed: int, rank: Callable[[int], int]) -> tuple[DataFrame, Column]:
    """The rows with their hash, and the test for coming before the row at the given shuffled rank.

    The cut is found on a stored copy of hash and keys, so no row is moved or sorted to take a
    sample of any size.
    """
    hashed = df.withColumn("__h", portable_hash(*keys, seed=seed))
    order = ["__h", *keys]
    n, (cut,) = cut_rows(materialize(hashed.select(*order), "hashes"), order, lambda n: [rank(n)])
    inside = F.lit(rank(n) >= n) if cut is None else before(order, cut, hashed.schema)
    return hashed, inside


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, uniform over seeds; everything when there are fewer."""
    hashed, inside = _cut(df, keys, seed, lambda _: n)
    return hashed.filter(inside).drop("__h")


def skip_first_fraction(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Drop the first int(fraction·N) rows of the shuffled order."""
    hashed, inside = _cut(df, keys, seed, lambda n: int(fraction * n))
    return hashed.filter(~inside).drop("__h")


def keep_fraction(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """The first int(fraction·N) rows of the shuffled order."""
    hashed, inside = _cut(df, keys, seed, lambda n: int(fraction * n))
    return hashed.filter(inside).drop("__h")


def repeated(df: DataFrame, times: int, name: str = "copy") -> DataFrame:
    """Each row `times` times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def mixture(
    base: DataFrame, keys: Sequence[str], n: int, extra: DataFrame, copies: int, seed: int = 42
) -> DataFrame:
    """n sampled rows of `base` plus `copies` copies of `extra`; `copy` numbers the repeats from 1."""
    sampled = sample_rows(base, keys, n, seed).withColumn("copy", F.lit(1))
    return sampled.unionByName(extra.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))))


def grouped_repeats(df: DataFrame, keys: Sequence[str], times: int, seed: int = 42) -> DataFrame:
    """Prompts in seeded random order, each repeated `times` with its repeats adjacent (`pos` 0..times-1)."""
    many = repeated(df.withColumn("shuffle_key", portable_hash(*keys, seed=seed)), times, "pos")
    return many.orderBy("shuffle_key", *keys, "pos")


def uniform_negative(key: Column, target: Column, items: int, seed: int = 42) -> Column:
    """A uniform item in [0, items) other than the target: draw from one fewer and step over the target.

    Items are dense numbers; other ids are mapped to such numbers first (`ranking.dense_ids`).
    """
    draw = portable_hash(key, seed=seed) % (items - 1)
    return F.when(draw >= target, draw + 1).otherwise(draw)
