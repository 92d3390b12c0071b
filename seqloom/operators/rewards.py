"""Rewards over candidate groups and offline policy diagnostics.

Group figures are windows over a group's few rows, the completions drawn for one prompt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.arrays import cosine
from seqloom.functions.text import same_answer
from seqloom.operators.ranking import keep_first_per_key, portable_hash

ADVANTAGE_FLOOR = 1e-4  # fixed value


def exact_match(completion: str, target: str) -> Column:
    return F.when(same_answer(completion, target), F.lit(1.0)).otherwise(F.lit(0.0))


def rank_penalties(group_size: int) -> list[float]:
    """Negative shares of 1 / log2(place + 2), adding up to -1."""
    gains = [1.0 / math.log2(i + 2) for i in range(group_size)]
    return [-g / sum(gains) for g in gains]


def rank_penalty(df: DataFrame, group: Sequence[str], pos: str, completion: str, target: str, group_size: int,
                 name: str = "rank_reward") -> DataFrame:
    """In groups with a hit, misses are penalised by place and hits get 0; groups without one get 0.

    A group has `group_size` rows, so one window over it takes one shuffle, shared with later windows on the group.
    """
    hit = same_answer(completion, target, blanks=False)
    any_hit = F.max(hit).over(Window.partitionBy(*group))
    share = F.get(F.array(*[F.lit(p) for p in rank_penalties(group_size)]), F.col(pos).cast("int"))
    return df.withColumn(name, F.when(any_hit & ~hit, share).otherwise(F.lit(0.0)))


def semantic_reward(df: DataFrame, vectors: DataFrame, target_item: str, candidate_item: str, name: str = "semantic_reward") -> DataFrame:
    """Cosine similarity of target and candidate vectors; `vectors` is (item_id, embedding).

    Vectors are joined to the distinct pairs only; the wide rows get the finished number. Without one of the two vectors
    (or with a null id) the reward is 0, and the row stays.
    """
    t = vectors.select(F.col("item_id").alias(target_item), F.col("embedding").alias("__t"))
    c = vectors.select(F.col("item_id").alias(candidate_item), F.col("embedding").alias("__c"))
    pairs = df.select(target_item, candidate_item).distinct().join(t, target_item).join(c, candidate_item)
    scored = pairs.select(target_item, candidate_item, cosine("__t", "__c").alias(name))
    return df.join(scored, [target_item, candidate_item], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def transition_scores(samples: DataFrame, last: str, target: str) -> DataFrame:
    """(last item, next item, score): how often one followed the other in the samples."""
    return samples.groupBy(F.col(last).alias("last"), F.col(target).alias("next")).agg(F.count(F.lit(1)).cast("double").alias("score"))


def collaborative_reward(
    df: DataFrame, scores: DataFrame, last: str, candidate: str, item_count: int, key: Sequence[str],
    seed: int = 42, name: str = "collaborative_reward",
) -> DataFrame:
    """Score of the candidate after the last history item; an unknown candidate (null) is scored as a seeded random item."""
    drawn = portable_hash(*key, seed=seed) % item_count
    rows = df.withColumn("__c", F.coalesce(F.col(candidate), drawn))
    table = scores.select(F.col("last").alias(last), F.col("next").alias("__c"), "score")
    return rows.join(table, [last, "__c"], "left").withColumn(name, F.coalesce("score", F.lit(0.0))).drop("score", "__c")


def weighted_sum(columns: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    weights = weights or [1.0] * len(columns)
    total = F.lit(0.0)
    for c, w in zip(columns, weights):
        total = total + F.col(c) * w
    return total


# The reward choices by name and the columns each one adds up.
REWARD_SETS = {
    "rule": ["rule_reward"],
    "ranking": ["rule_reward", "rank_reward"],
    "ranking_only": ["rank_reward"],
    "semantic": ["semantic_reward"],
    "sasrec": ["collaborative_reward"],
}


def reward_columns(kind: str, extra: dict[str, Callable[[], Column]] | None = None) -> list[str]:
    """Columns of a named reward; `extra` registers caller-made ones."""
    if extra and kind in extra:
        return [kind]
    return REWARD_SETS[kind]


def caller_reward(fn: Callable[..., Sequence[float]], prompt: str, completion: str, *columns: str) -> Column:
    """A reward function of the caller, `fn(prompts, completions, **columns) -> floats`, run on Arrow batches."""

    def batch(*values: pd.Series) -> pd.Series:
        prompts, completions, *rest = (v.tolist() for v in values)
        return pd.Series(fn(prompts=prompts, completions=completions, **dict(zip(columns, rest))), dtype="float64")

    batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "double")(prompt, completion, *columns)


def advantages(df: DataFrame, group: Sequence[str], reward: str, name: str = "advantage") -> DataFrame:
    """(reward - group mean) / (group sample deviation + 1e-4), in one window over the group's few rows."""
    same = Window.partitionBy(*group)
    value = (F.col(reward) - F.avg(reward).over(same)) / (F.stddev_samp(reward).over(same) + ADVANTAGE_FLOOR)
    return df.withColumn(name, value)


def select_completions(df: DataFrame, group: Sequence[str], pos: str, completion: str, target: str, g: int) -> DataFrame:
    """g completions per group from a larger draw: target copies first, then the others by frequency, round after round.

    Copies are counted before anything is shuffled, and only the g rounds that can matter are
    spelled out, so a heavily repeated completion stays one row.
    """
    counts = df.groupBy(*group, completion, target).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    is_target = (F.col(completion) == F.col(target)).cast("int")
    rounds = counts.withColumn("is_target", is_target).withColumn(
        "round", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(g)).cast("int"))))
    order = [F.desc("is_target"), F.when(F.col("is_target") == 1, 0).otherwise(F.col("round")), F.desc("n"), "first", "round"]
    kept = keep_first_per_key(rounds, group, order, g)
    return kept.select(*group, completion, target, F.col("round").cast("bigint").alias("round"), "n")


def inject_target(df: DataFrame, pos: str, completion: str, target: str, group_size: int) -> DataFrame:
    """The last slot of every group holds the target."""
    return df.withColumn(completion, F.when(F.col(pos) == group_size - 1, F.col(target)).otherwise(F.col(completion)))


def completion_diversity(df: DataFrame, group: Sequence[str], completion: str, group_size: int) -> DataFrame:
    """Mean over groups of distinct completions / group size."""
    per_group = df.groupBy(*group).agg(F.countDistinct(completion).alias("d"))
    return per_group.agg((F.avg(F.col("d") / group_size)).alias("completion_diversity"), F.count(F.lit(1)).alias("groups"))


def token_diversity(df: DataFrame, tokens: str, pad: Column) -> DataFrame:
    """Distinct tokens / tokens, padding left out; 0 when there are none."""
    flat = df.select(F.explode(tokens).alias("t")).filter(F.col("t") != pad)
    counts = flat.groupBy("t").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("distinct_tokens"), F.sum("n").alias("tokens"))
    return counts.withColumn("token_diversity", F.when(F.col("tokens") > 0, F.col("distinct_tokens") / F.col("tokens")).otherwise(F.lit(0.0)))


def kl_terms(logp: str, ref: str) -> Column:
    """exp(d) - d - 1 per token, d = reference minus current log-probability."""
    return F.zip_with(ref, logp, lambda r, c: F.exp(r - c) - (r - c) - F.lit(1.0))


def masked_total(values: Column | str, mask: str) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)


def mask_size(mask: str) -> Column:
    return F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)


def kl_per_sequence(df: DataFrame, logp: str, ref: str, mask: str) -> DataFrame:
    """Adds the masked mean KL estimate `kl` and `completion_length`."""
    return df.withColumn("completion_length", mask_size(mask)).withColumn(
        "kl", masked_total(kl_terms(logp, ref), mask) / F.col("completion_length"))


def objective(df: DataFrame, logp: str, old: str, ref: str, mask: str, advantage: str, beta: float = 0.04) -> DataFrame:
    """Objective values (no gradients) under the three ways of averaging, in one pass.

    `per_sequence` averages sequence means, `per_token` averages all tokens, `sequence_ratio`
    weighs the advantage by the exponent of the mean token log-ratio.
    """
    ratio = F.zip_with(logp, old, lambda c, o: F.exp(c - o))
    loss = F.zip_with(ratio, kl_terms(logp, ref), lambda r, k: -(r * F.col(advantage) - F.lit(beta) * k))
    log_ratio = F.zip_with(logp, old, lambda c, o: c - o)
    n = mask_size(mask)
    rows = df.select(
        masked_total(loss, mask).alias("loss"), n.alias("n"),
        (F.lit(beta) * masked_total(kl_terms(logp, ref), mask) / n
         - F.exp(masked_total(log_ratio, mask) / n) * F.col(advantage)).alias("seq"))
    return rows.agg(F.avg(F.col("loss") / F.col("n")).alias("per_sequence"),
                    (F.sum("loss") / F.sum("n")).alias("per_token"), F.avg("seq").alias("sequence_ratio"))


def reward_log(df: DataFrame, group: Sequence[str], columns: Sequence[str], reward: str) -> DataFrame:
    """Run means of every reward column, of the total, and of its deviation inside groups."""
    sums = [F.sum(c).alias(f"s_{c}") for c in columns]
    per_group = df.groupBy(*group).agg(*sums, F.sum(reward).alias("s_total"), F.count(F.lit(1)).alias("n"), F.stddev_samp(reward).alias("std"))
    return per_group.agg(
        *[(F.sum(f"s_{c}") / F.sum("n")).alias(f"mean_{c}") for c in columns],
        (F.sum("s_total") / F.sum("n")).alias("mean_reward"), F.avg("std").alias("reward_std"))

