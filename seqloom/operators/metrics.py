"""Offline ranking metrics: hit rate and NDCG from ranked lists or from full score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.text import answer_core, strip

# Cut-offs reported.
BEAM_KS = (1, 3, 5, 10, 20, 50)
SCORE_KS = (1, 3, 5, 10, 20)
TRAINING_KS = (3, 5, 10, 20)


def gain(place: Column) -> Column:
    """1 / log2(place + 2) for a 0-based place."""
    return F.lit(1.0) / F.log2(place + 2)


def clean_answers(predict: str) -> Column:
    return F.transform(predict, lambda p: strip(F.btrim(p, F.lit('"\n'))))


def hit_place(answers: Column | str, target: Column) -> Column:
    """0-based place of the first matching answer, null without a match."""
    at = F.array_position(answers, target)
    return F.when(at > 0, at - 1)


def at_ks(place: Column, ks: Sequence[int], weight: Column | None = None) -> list[Column]:
    """Sum of hits and of gains within each K, all in one aggregation."""
    one = F.lit(1.0) if weight is None else weight
    cols = []
    for k in ks:
        inside = place < k
        cols += [F.sum(F.when(inside, one).otherwise(0.0)).alias(f"h{k}"), F.sum(F.when(inside, one * gain(place)).otherwise(0.0)).alias(f"g{k}")]
    return cols


def per_k(sums: DataFrame, ks: Sequence[int], count: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row of sums to one row per K."""
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), (F.col(f"h{k}") / F.col(count)).alias("hr"),
                              (F.col(f"g{k}") / F.col(count)).alias("ndcg")) for k in ks])
    return sums.select(*keep, F.explode(rows).alias("m")).select(*keep, "m.*")


def ranked_metrics(df: DataFrame, predict: str, target: str, ks: Sequence[int] = BEAM_KS, clean: bool = True) -> DataFrame:
    """(k, requests, hr, ndcg) over ranked answer lists: each K over the requests that list at least K answers.

    A target may be a list; its first entry counts. K without such a request is left out.
    """
    if df.schema[target].dataType.typeName() == "array":
        df = df.withColumn(target, F.get(target, F.lit(0)))
    answers = clean_answers(predict) if clean else F.col(predict)
    wanted = answer_core(target) if clean else F.col(target)
    placed = df.select(hit_place(answers, wanted).alias("place"), F.size(predict).alias("beams"))
    sums = placed.agg(*[c for k in ks for c in _usable(k)])
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"n{k}").alias("requests"), F.try_divide(f"h{k}", f"n{k}").alias("hr"),
                              F.try_divide(f"g{k}", f"n{k}").alias("ndcg")) for k in ks])
    return sums.select(F.explode(rows).alias("m")).select("m.*").filter("requests > 0")


def _usable(k: int) -> list[Column]:
    """Requests with at least k answers, their hits and gains within k."""
    enough, inside = F.col("beams") >= k, F.col("place") < k
    return [F.count_if(enough).alias(f"n{k}"), F.sum(F.when(enough & inside, 1.0).otherwise(0.0)).alias(f"h{k}"),
            F.sum(F.when(enough & inside, gain(F.col("place"))).otherwise(0.0)).alias(f"g{k}")]


def one_per_group(df: DataFrame, group: Sequence[str], predict: str, target: str) -> DataFrame:
    """One row of every prompt group, for metrics that count a prompt once; all its rows carry the same list.

    Equal rows are dropped by hash where they arise, so no task sorts the copies of a list, and the rest is sorted in tasks of its own.
    """
    once = df.select(*group, predict, target).distinct().repartition(*group)
    return once.groupBy(*group).agg(F.min(F.struct(predict, target)).alias("r")).select(*group, "r.*")


def invalid_before_hit(df: DataFrame, predict: str, target: str, catalogue: DataFrame, name: str) -> DataFrame:
    """How many listed answers, up to the hit, are in no catalogue entry."""
    answers = clean_answers(predict)
    place = hit_place(answers, answer_core(target))
    seen = F.when(place.isNotNull(), F.slice(answers, F.lit(1), (place + 1).cast("int"))).otherwise(answers)
    flat = df.select(F.explode(seen).alias("answer")).groupBy("answer").agg(F.count(F.lit(1)).alias("n"))
    known = catalogue.select(F.col(name).alias("answer")).distinct()
    return flat.join(known, "answer", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("invalid"))


def target_places(scores: DataFrame, targets: DataFrame, request: str, item: str, score: str) -> DataFrame:
    """(request, place): items scored above the request's target, equal scores in item order.

    A join and a count: no request's score list is sorted or gathered.
    """
    own = targets.select(request, F.col(item).alias("__target")).join(
        scores.select(request, F.col(item).alias("__target"), F.col(score).alias("__score")), [request, "__target"])
    ahead = (F.col(score) > F.col("__score")) | ((F.col(score) == F.col("__score")) & (F.col(item) < F.col("__target")))
    return scores.join(own, request).groupBy(request).agg(F.sum(ahead.cast("bigint")).alias("place"))


def score_metrics(places: DataFrame, ks: Sequence[int] = SCORE_KS) -> DataFrame:
    return per_k(places.agg(*at_ks(F.col("place"), ks), F.count(F.lit(1)).alias("n")), ks, "n")


def behaviour_metrics(places: DataFrame, reward: str, click_reward: float, ks: Sequence[int]) -> DataFrame:
    """Per K: total reward, and hits and gains split into clicks and purchases."""
    click = F.col(reward) == F.lit(click_reward)
    cols = []
    for k in ks:
        inside = F.col("place") < k
        cols.append(F.sum(F.when(inside, F.col(reward)).otherwise(0.0)).alias(f"r{k}"))
        for kind, flag in (("c", click), ("p", ~click)):
            cols += [F.sum((inside & flag).cast("bigint")).alias(f"h{kind}{k}"),
                     F.sum(F.when(inside & flag, gain(F.col("place"))).otherwise(0.0)).alias(f"g{kind}{k}")]
    rows = F.array(*[F.struct(
        F.lit(k).cast("bigint").alias("k"), F.col(f"r{k}").alias("total_reward"), F.col(f"hc{k}").alias("hit_click"),
        F.col(f"gc{k}").alias("ndcg_click"), F.col(f"hp{k}").alias("hit_purchase"), F.col(f"gp{k}").alias("ndcg_purchase")) for k in ks])
    return places.agg(*cols).select(F.explode(rows).alias("m")).select("m.*")


def top_beams(df: DataFrame, predict: str, k: int) -> DataFrame:
    return df.withColumn(predict, F.slice(predict, 1, k))
