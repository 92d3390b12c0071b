"""Array and vector expressions: padding, truncation, masks, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED_LABEL = -100  # fixed value: positions left out of the training target


def keep_last(values: Column | str, n: int) -> Column:
    """The newest n elements (a plain negative slice start would empty short arrays)."""
    col = F.col(values) if isinstance(values, str) else values
    return F.slice(col, F.greatest(F.size(col) - n + 1, F.lit(1)), n)


def pad_right(values: Column | str, length: int, pad: Column) -> Column:
    """Exactly `length` elements: the newest ones, then padding."""
    col = F.col(values) if isinstance(values, str) else values
    return F.concat(keep_last(col, length), F.array_repeat(pad, F.greatest(F.lit(length) - F.size(col), F.lit(0))))


def pad_left_in_batch(df: DataFrame, batch: str, values: str, pad: Column) -> DataFrame:
    """Left-pad to the longest array of each batch and add the matching 0/1 `mask`."""
    longest = df.groupBy(batch).agg(F.max(F.size(values)).alias("__longest"))
    gap = F.col("__longest") - F.size(values)
    return (
        df.join(longest, batch)
        .withColumn("mask", F.concat(F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size(values))))
        .withColumn(values, F.concat(F.array_repeat(pad, gap), F.col(values)))
        .drop("__longest")
    )


def training_tokens(prompt: str, answer: str, max_len: int | None = None) -> tuple[Column, Column, Column]:
    """(tokens, mask, labels): prompt positions carry no label; with `max_len`, all keep that many newest."""
    tokens = F.concat(F.col(prompt), F.col(answer))
    mask = F.array_repeat(F.lit(1), F.size(tokens))
    labels = F.concat(F.array_repeat(F.lit(IGNORED_LABEL), F.size(prompt)), F.col(answer))
    return tuple(c if max_len is None else keep_last(c, max_len) for c in (tokens, mask, labels))


def until_end_token(tokens: str, end: Column) -> tuple[Column, Column]:
    """(kept tokens, 0/1 mask): everything after the first end token is masked, the token itself stays."""
    at = F.array_position(F.col(tokens), end)
    kept = F.when(at > 0, at.cast("int")).otherwise(F.size(tokens))
    mask = F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.size(tokens) - kept))
    return F.slice(F.col(tokens), F.lit(1), kept), mask


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine(a: Column | str, b: Column | str, floor: float = 1e-8) -> Column:
    """Cosine similarity; the norm product never falls below `floor`."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.greatest(norm, F.lit(floor))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def sanitize(vector: Column | str) -> Column:
    """NaN and infinities become 0."""
    col = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(col, lambda x: F.when(_finite(x), x).otherwise(F.lit(0.0).cast("float")))


def _finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def count_where(values: Column, keep) -> Column:
    return F.size(F.filter(values, keep)).cast("bigint")
