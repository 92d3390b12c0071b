"""Catalogue-constrained candidates: prefix tables, masks and constrained beam expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import trie
from seqloom.session import materialize

END = "</s>"
BLOCKED = -1_000_000.0  # fixed value: added to the log-probability of a token the catalogue does not allow


def prefix_rows(catalogue: DataFrame, tokens: str, separator: str = "", end: str = END) -> DataFrame:
    """Distinct (prefix, next token) pairs of all paths; a full path leads to the end token.

    The row form is the scalable one: pairs are deduplicated map-side, and no prefix gathers its
    members. Paths of different lengths mix freely.
    """
    path = F.concat(F.col(tokens), F.array(F.lit(end)))
    steps = F.transform(path, lambda t, i: F.struct(
        F.array_join(F.slice(F.col(tokens), F.lit(1), i), separator).alias("prefix"), t.alias("next")))
    return catalogue.select(F.explode(steps).alias("s")).select("s.prefix", "s.next").distinct()


def prefix_map(rows: DataFrame) -> DataFrame:
    """(prefix, allowed): the pairs gathered per prefix, for token sets bounded by the codebook size."""
    return rows.groupBy("prefix").agg(F.sort_array(F.collect_list("next")).alias("allowed"))


def allowed_tokens(requests: DataFrame, allowed: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Adds `allowed`; an unknown prefix allows nothing."""
    known = allowed.withColumnRenamed("prefix", prefix)
    return requests.join(known, prefix, "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))


def log_softmax(scores: DataFrame, group: Sequence[str], score: str, name: str = "logp") -> DataFrame:
    """score - log(sum(exp(score))) per group, shifted by the group's maximum.

    Two map-side-combined aggregates joined back: a group spread over many tasks is never gathered. The scores are stored
    once, as all three passes read them.
    """
    scores = materialize(scores, "scores")
    top = scores.groupBy(*group).agg(F.max(score).alias("__top"))
    sums = scores.join(top, list(group)).groupBy(*group, "__top").agg(F.sum(F.exp(F.col(score) - F.col("__top"))).alias("__sum"))
    norm = F.col("__top") + F.log("__sum")
    return scores.join(sums, list(group)).withColumn(name, F.col(score) - norm).drop("__top", "__sum")


def mask_scores(scored: DataFrame, rows: DataFrame, prefix: str, token: str, logp: str, name: str = "masked") -> DataFrame:
    """Log-probabilities with the blocking constant added to tokens the prefix does not allow."""
    allowed = rows.select(F.col("prefix").alias(prefix), F.col("next").alias(token), F.lit(True).alias("__ok"))
    return scored.join(allowed, [prefix, token], "left").withColumn(
        name, F.col(logp) + F.when(F.col("__ok"), F.lit(0.0)).otherwise(F.lit(BLOCKED))).drop("__ok")


def expand_beams(
    requests: DataFrame, catalogue: DataFrame, tokens: str, scores: DataFrame, request: str, beams: int, steps: int,
    separator: str = "", part_paths: int | None = None,
) -> DataFrame:
    """Best `beams` catalogue paths of `steps` tokens per request as (request, sid, total, place), place 0 first.

    `catalogue` has the paths in the array column `tokens`; `scores` is (request, step, token, score), each token once per request
    and step. The total is the plain sum, without a length penalty; ties go to the smaller path text. Scores are gathered once
    per request, and tries of the catalogue are walked over those rows, step by step.
    """
    parts = trie.tries(requests.sparkSession, catalogue, tokens, part_paths)
    if not parts:
        return requests.select(request, F.lit("").alias("sid"), F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("place")).limit(0)
    walked = trie.complete(trie.walk(requests, request, scores, parts, beams, steps, separator), parts)
    flat = walked.select(request, F.posexplode("beams").alias("place", "b"))
    return flat.select(request, F.col("b.text").alias("sid"), "b.total", F.col("place").cast("bigint").alias("place"))
