"""From item vectors to an index of unique semantic IDs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqloom.functions import sids
from seqloom.operators.aggregates import suffix_collisions
from seqloom.operators.clusters import residual_balanced_kmeans
from seqloom.operators.quantize import fit_residual_kmeans
from seqloom.session import materialize


def sid_index(vectors: DataFrame, k: int, levels: int, balanced: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(codebooks, index) from (item_id, vec): fit, encode, number what shares a path, write tokens.

    The index has item_id, codes (one more level where a path occurs more than once), tokens and sid.
    """
    fit = residual_balanced_kmeans if balanced else fit_residual_kmeans
    books, codes = fit(vectors, k, levels, seed=seed)
    unique = materialize(suffix_collisions(codes, "item_id", "codes"), "unique-codes")
    return books, unique.withColumn("tokens", sids.tokens("codes", 0)).withColumn("sid", sids.sid("tokens"))
