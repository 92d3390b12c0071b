"""Hashes that any engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TEXT = "\u0000"  # stands for null, so that (null, a) and (a, null) differ


def portable_hash(*cols: Column | str, seed: int = 42) -> Column:
    """60-bit non-negative hash of the values and a seed: any engine with md5 gives the same number."""
    values = [F.col(c) if isinstance(c, str) else c for c in cols]
    text = F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit(NULL_TEXT)) for v in values], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
