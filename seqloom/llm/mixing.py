"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Every source has a weight schedule over training progress 0..1, piecewise linear between knots. Its integral is the
source's overall weight, which fixes the target number of words. The running integral, scaled to the target, is the
source's cumulative demand; inverting it at the place of a document in its source's shuffled stream gives the training
position of that document. Sorting by position yields the training order.

Defined results. Null or empty text: size 0, never taken. Null source: a source of its own, last in order. A source
without words: target 0. Repeated rows and repeated ids: rows are separate documents; ties in the shuffle are broken by
a hash of the text. Empty table: empty result. Other columns pass through untouched; internal columns start with `_mx_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators.ranking import dense_ids
from seqloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SLOTS = 4096  # parts of a source's shuffled stream, by the leading hex digits of the shuffle key
SHARE, MAX_REPEATS = 1.5, 2
# overall weights by rank of the source, with the schedule that spends each: rising, level, falling
SCHEDULES = [[(0.0, 1.5), (1.0, 4.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 3.0), (1.0, 1.0)]]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def schedule_area(knots: Column) -> Column:
    """Running integral of a schedule at its knots."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: (F.get(knots, i)["t"] - F.get(knots, i - 1)["t"]) * (F.get(knots, i)["w"] + F.get(knots, i - 1)["w"]) / 2)
    return F.aggregate(pieces, F.array(F.lit(0.0)),
                       lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def invert_schedule(knots: Column, area: Column, demand: Column) -> Column:
    """Progress at which the running integral of the schedule reaches `demand`."""
    i = F.size(F.filter(F.slice(area, 2, F.size(area) - 2), lambda x: x <= demand))
    left, right = F.get(knots, i), F.get(knots, i + 1)
    rest = demand - F.get(area, i)
    slope = (right["w"] - left["w"]) / (right["t"] - left["t"])
    root = F.sqrt(F.greatest(left["w"] * left["w"] + 2 * slope * rest, F.lit(0.0)))
    return F.when(rest <= 0, left["t"]).otherwise(left["t"] + 2 * rest / (left["w"] + root))


def source_targets(sizes: DataFrame, schedules: list[list[tuple[float, float]]], share: float,
                   max_repeats: int) -> DataFrame:
    """Targets per source from (`_mx_source`, `_mx_size`): shares by weight, no source above `max_repeats` times its size.

    A common level rises, and sources above their cap leave it, until none does. Only sums over the sources reach the driver.
    """
    def literal(knots):
        return F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in knots])

    ranked = dense_ids(sizes.withColumn("_mx_last", F.col("_mx_source").isNull()), ["_mx_last", "_mx_source"], "_mx_rank")
    knots = F.get(F.array(*[literal(k) for k in schedules]), F.col("_mx_rank") % len(schedules))
    table = materialize(
        ranked.withColumn("_mx_knots", knots).withColumn("_mx_area", schedule_area(F.col("_mx_knots")))
        .withColumn("_mx_weight", F.element_at("_mx_area", -1)).withColumn("_mx_cap", F.col("_mx_size") * max_repeats)
        .drop("_mx_last", "_mx_rank"), "sources")
    level, capped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("_mx_weight") > F.col("_mx_cap")
        sums = table.agg(F.coalesce(F.sum("_mx_size"), F.lit(0)).alias("all"), F.count_if(over).alias("n"), F.sum(F.when(over, F.col("_mx_cap"))).alias("held"),
                         F.sum(F.when(~over, F.col("_mx_weight"))).alias("free")).first()
        if sums["n"] == capped or not sums["free"]:
            break
        capped, level = sums["n"], (sums["all"] * share - (sums["held"] or 0)) / sums["free"]
    target = F.when(over, F.col("_mx_cap").cast("double")).otherwise(F.lit(level) * F.col("_mx_weight"))
    return table.select("_mx_source", F.col("_mx_size").alias("_mx_source_size"), target.alias("_mx_target"), "_mx_knots", "_mx_area")


def assign_positions(docs: DataFrame, schedules: list[list[tuple[float, float]]] = SCHEDULES, share: float = SHARE,
                     max_repeats: int = MAX_REPEATS, seed: str = "mix", whole: bool = False, id_col: str = "doc_id",
                     text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each document with `_mx_size`, `_mx_source_size`, `_mx_target`, `_mx_taken` and `_mx_copies`.

    `_mx_copies` lists (position, words) of every time the document is read. With `whole`, a document at the end of
    its source's demand is read in full if at least half of it is due, else not; otherwise its first words are read.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    rows = (docs.withColumn("_mx_size", n_words(F.col(text_col))).withColumn("_mx_source", F.col(source_col))
            .withColumn("_mx_key", key).withColumn("_mx_tie", F.xxhash64(F.col(text_col)))
            .withColumn("_mx_slot", F.conv(F.substring("_mx_key", 1, 3), 16, 10).cast("int") % SLOTS))
    # totals per source and slot come from a narrow second reading, so the text is not kept for them
    totals = (docs.select(n_words(F.col(text_col)).alias("_mx_size"), F.col(source_col).alias("_mx_source"), key.alias("_mx_key"))
              .groupBy("_mx_source", (F.conv(F.substring("_mx_key", 1, 3), 16, 10).cast("int") % SLOTS).alias("_mx_slot"))
              .agg(F.sum("_mx_size").alias("_mx_slot_size")))
    targets = source_targets(totals.groupBy("_mx_source").agg(F.sum("_mx_slot_size").alias("_mx_size")),
                             schedules, share, max_repeats)
    before = Window.partitionBy("_mx_source").orderBy("_mx_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_mx_slot_start", F.coalesce(F.sum("_mx_slot_size").over(before), F.lit(0))).drop("_mx_slot_size")
    starts = starts.withColumnRenamed("_mx_source", "_mx_s").join(
        targets, F.col("_mx_s").eqNullSafe(F.col("_mx_source"))).drop("_mx_source").withColumnRenamed("_mx_slot", "_mx_sl")
    within = (Window.partitionBy("_mx_source", "_mx_slot").orderBy("_mx_key", F.col(id_col), "_mx_size", "_mx_tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_mx_offset", F.coalesce(F.sum("_mx_size").over(within), F.lit(0)))
    rows = rows.join(starts, F.col("_mx_source").eqNullSafe(F.col("_mx_s")) & (F.col("_mx_slot") == F.col("_mx_sl")))
    place = F.col("_mx_slot_start") + F.col("_mx_offset")

    def copy(k: Column) -> Column:
        start = k * F.col("_mx_source_size") + place
        left = F.floor("_mx_target") - start
        if whole:
            words = F.when(2 * left >= F.col("_mx_size"), F.col("_mx_size")).otherwise(F.lit(0))
        else:
            words = F.greatest(F.lit(0), F.least(F.col("_mx_size"), left))
        total = F.element_at("_mx_area", -1)
        demand = F.least(F.coalesce(F.try_divide(start, F.col("_mx_target")), F.lit(0.0)) * total, total)
        return F.struct(invert_schedule(F.col("_mx_knots"), F.col("_mx_area"), demand).alias("position"),
                        words.cast("long").alias("words"), k.cast("int").alias("copy"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), copy), lambda c: c["words"] > 0)
    return (rows.withColumn("_mx_copies", F.when(F.col("_mx_size") > 0, copies).otherwise(F.filter(copies, lambda c: F.lit(False))))
            .withColumn("_mx_taken", F.aggregate("_mx_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
            .drop("_mx_s", "_mx_sl", "_mx_slot", "_mx_key", "_mx_tie", "_mx_offset", "_mx_slot_start", "_mx_knots", "_mx_area"))


def training_order(assigned: DataFrame) -> DataFrame:
    """One row per reading of a document, range-sorted by training position (`_mx_position`, `_mx_words`)."""
    rows = (assigned.select("*", F.explode("_mx_copies").alias("_mx_copy"))
            .withColumn("_mx_position", F.col("_mx_copy.position")).withColumn("_mx_words", F.col("_mx_copy.words")))
    # a constant number of ranges would not grow with the data: the session's shuffle setting decides
    return rows.repartitionByRange("_mx_position").sortWithinPartitions("_mx_position").drop("_mx_copies", "_mx_copy")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order, each as often as it is read; columns of `docs` plus the `_mx_` ones."""
    return training_order(assign_positions(docs, **options))


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    rows = assign_positions(docs)
    first = F.get(F.col("_mx_copies"), 0)["position"]
    return (rows.select("doc_id", F.col("_mx_size").alias("size"), F.col("_mx_source_size").alias("source_size"),
                        F.col("_mx_target").alias("target"), F.col("_mx_taken").alias("taken"),
                        F.size("_mx_copies").cast("long").alias("readings"), first.alias("first_position"))
            .repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id"))


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLES = {"op1_mix_sources": r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(':' || doc_id, '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][turn + 1]::DOUBLE AS weight, [1.5, 1.0, 3.0][turn + 1]::DOUBLE AS w0,
             [4.5, 1.0, 1.0][turn + 1]::DOUBLE AS w1, 2 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lv FROM w
      WINDOW b AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN lv * weight <= cap THEN max(CASE WHEN lv * weight <= cap THEN lv END) OVER () * weight
                     ELSE cap::DOUBLE END AS target FROM l),
p AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
q AS (SELECT p.*, t.source_size, t.target, t.weight, t.w0, t.w1,
             CAST(greatest(0, least(size, floor(target)::BIGINT - start)) AS BIGINT) AS c0,
             CAST(greatest(0, least(size, floor(target)::BIGINT - start - t.source_size)) AS BIGINT) AS c1,
             least(start::DOUBLE / target * weight, weight) AS y FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, c0 + c1 AS taken, CAST((c0 > 0)::INT + (c1 > 0)::INT AS BIGINT) AS readings,
       CASE WHEN c0 > 0 THEN CASE WHEN y <= 0 THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + 2 * y / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * y)) END
       END AS first_position FROM q"""}
