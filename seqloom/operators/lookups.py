"""Equi-join look-ups: re-keying, titles, SIDs, metadata and vectors for items."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.operators.aggregates import last_wins


def only_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_semi")


def without(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return df.join(removed.select(key), key, "left_anti")


def prune_to(df: DataFrame, users: DataFrame, items: DataFrame, user: str, item: str) -> DataFrame:
    return only_known(only_known(df, users, user), items, item)


def rekey_events(df: DataFrame, user_ids: DataFrame, item_ids: DataFrame, user: str, item: str) -> DataFrame:
    """Dense ids for user and item; rows with an unmapped side drop out."""
    return df.join(user_ids, user).join(item_ids, item)


def map_elements(
    df: DataFrame, key: Sequence[str], ids: str, table: DataFrame, table_key: str,
    values: dict[str, Column], keep_unmapped: bool = False, near: Sequence[str] | None = None, one: str | None = None,
) -> DataFrame:
    """Replace each element of the array `ids` by columns looked up in `table`, in order.

    Result columns are parallel arrays named by `values`. Unmapped elements are dropped, or
    kept through the given expressions (which then see nulls) when `keep_unmapped`. Rows with
    no element keep empty arrays. `key` must identify a row. Rows equal in `near` (the key, unless given) are a block, which
    looks an id up once for all its rows; a block should be a few dozen rows with ids in common, and rows
    that repeat a key belong in one. A row is moved to its block's
    entries once, and a hot id is a skewed join for adaptive execution to split. The entries found for the column `one`, if
    given, come as `__one`, an array of structs of `values`.
    """
    near = list(near or key)
    rest = [c for c in df.columns if c not in (*key, *near, ids)]
    asked = F.array_distinct(F.concat(F.coalesce(ids, F.array()), F.array(one))) if one else F.array_distinct(ids)
    wanted = df.select(*near, F.explode(asked).alias("__id")).distinct()
    looked = wanted.join(table.withColumn("__found", F.lit(True)), wanted["__id"] == table[table_key], "left" if keep_unmapped else "inner")
    entry = F.struct("__id", *[v.alias(n) for n, v in values.items()])
    at = [F.col(c).alias(f"__near{n}") for n, c in enumerate(near)]
    blocks = looked.groupBy(*at).agg(F.sort_array(F.collect_list(entry)).alias("__entries"))
    blocks = blocks.withColumn("__ids", F.array_distinct("__entries.__id")).withColumn("__sets", F.transform(  # one set of entries per id
        "__ids", lambda x: F.filter("__entries", lambda e: e["__id"].eqNullSafe(x)))).drop("__entries")

    def found(x: Column) -> Column:
        place = F.when(x.isNull(), 0).otherwise(F.array_position("__ids", x) - 1).cast("int")  # null is the first id there is
        return F.when(x.isNotNull() | F.get("__ids", F.lit(0)).isNull(), F.get("__sets", F.when(place >= 0, place)))

    def placed(x: Column, pos: Column) -> Column:
        kinds = blocks.schema["__sets"].dataType.elementType.elementType
        missing = F.struct(pos.alias("__pos"), x.alias("__id"), F.lit(False).alias("__keep"), *[F.lit(None).cast(kinds[n].dataType).alias(n) for n in values])
        return F.coalesce(F.transform(found(x), lambda e: F.struct(
            pos.alias("__pos"), x.alias("__id"), F.lit(True).alias("__keep"), *[e[n].alias(n) for n in values])), F.array(missing))

    rows = df.groupBy(*dict.fromkeys([*near, *key])).agg(F.first(F.struct(F.lit(1).alias("__one"), *rest)).alias("__rest"), F.collect_list(ids).alias("__lists"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__near{n}")) for n, c in enumerate(near)])
    listed = F.flatten(F.transform("__lists", lambda xs: F.flatten(F.transform(xs, placed))))
    gathered = rows.join(blocks, same, "left").withColumn("__all", F.sort_array(listed))
    kept = F.filter("__all", lambda e: e["__keep"])
    other = [c for c in near if c not in key and c in df.columns]
    return gathered.select(
        *key, *other, *[F.col(f"__rest.{c}").alias(c) for c in rest], F.col("__all.__id").alias(ids),
        *[F.transform(kept, _field(n)).alias(n) for n in values], *([found(F.col(one)).alias("__one")] if one else []))


def sid_samples(
    samples: DataFrame, key: Sequence[str], history: str, target: str, user: str, items: DataFrame, sids: DataFrame,
    near: Sequence[str] | None = None,
) -> DataFrame:
    """Sample rows with ids, titles and SIDs of history and target side by side.

    Samples whose target has no SID drop out; history SIDs and titles skip unmapped items.
    `items` is (item_id, title), `sids` is (item_id, sid); a missing title reads Item_<id>. `target` is part of the key, and
    `near` as in `map_elements`: targets are looked up with the histories, so samples with their texts are not moved again.
    """
    default_title = F.concat(F.lit("Item_"), F.col("item_id").cast("string"))
    item_titles = items.select("item_id", F.coalesce("title", default_title).alias("title"))
    lookup = item_titles.join(sids.select("item_id", "sid", F.lit(True).alias("coded")), "item_id", "full_outer")
    known = map_elements(samples, key, history, lookup.withColumnRenamed("item_id", "__k"), "__k", {
        "__title": F.col("title"), "__sid": F.col("sid"), "__coded": F.col("coded")}, near=near, one=target)
    known = known.withColumn("__target", F.explode(F.filter("__one", lambda e: e["__coded"])))
    return known.select(
        *[c for c in key if c not in (user, target, history)],
        F.concat(F.lit("A"), F.col(user).cast("string")).alias("user_id"),
        F.filter("__title", lambda t: t.isNotNull()).alias("history_item_title"),
        F.coalesce("__target.__title", F.concat(F.lit("Item_"), F.col(target).cast("string"))).alias("item_title"),
        F.col(history).alias("history_item_id"), F.col(target).alias("item_id"),
        F.filter("__sid", lambda s: s.isNotNull()).alias("history_item_sid"), F.col("__target.__sid").alias("item_sid"))


def item_features(items: DataFrame, meta: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Cleaned features of the kept items; the last metadata row per asin wins, items without any drop out.

    `items` is (asin, item_id); `meta` has asin, title, description, brand, categories (raw JSON text) and `seq`.
    """
    latest = last_wins(meta, "asin", seq, ["title", "description", "brand", "categories"])
    return items.join(latest, "asin").select(
        "item_id",
        F.when(text.title_present("title"), text.strip(F.col("title"))).otherwise(text.clean_review("title")).alias("title"),
        text.clean_review(text.description_text("description")).alias("description"),
        F.coalesce(text.clean_brand("brand"), F.lit("")).alias("brand"),
        text.join_categories(text.parse_categories("categories")).alias("categories"))


def review_texts(reviews: DataFrame, user: str, item: str, ts: str, review: str, summary: str, seq: Sequence[str]) -> DataFrame:
    """Cleaned review and summary per (user, item, time); the last row of a repeated key wins."""
    last = F.max_by(F.struct(review, summary), F.struct(*seq))
    kept = reviews.groupBy(user, item, ts).agg(last.alias("__last"))
    return kept.select(user, item, ts, text.clean_review(F.col(f"__last.{review}")).alias("review"),
                       text.clean_review(F.col(f"__last.{summary}")).alias("summary"))


def align_embeddings(items: DataFrame, vectors: DataFrame, item: str, idx: str, dim: int) -> DataFrame:
    """One vector per dense item id: zeros where missing; vectors of another length are ignored."""
    usable = vectors.filter(F.size("embedding") == dim).select(item, "embedding")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    joined = items.join(usable, item, "left")
    return joined.select(idx, F.coalesce("embedding", zeros).alias("embedding"), F.col("embedding").isNotNull().alias("found"))


def align_maps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "full_outer")


def rekey_index(index: DataFrame, old_ids: DataFrame, new_ids: DataFrame) -> DataFrame:
    """SID index moved from old dense ids to new ones through the original key, in text order of the new id.

    `old_ids` and `new_ids` are (orig, idx); `index` is (item_id, sid).
    """
    old = old_ids.select(F.col("orig"), F.col("idx").alias("item_id"))
    new = new_ids.select(F.col("orig"), F.col("idx").alias("new_id"))
    moved = index.join(old, "item_id").join(new, "orig").select(F.col("new_id").alias("item_id"), "sid")
    return moved.orderBy(F.col("item_id").cast("string"))


def invalid_predictions(predictions: DataFrame, catalogue: DataFrame, answer: str, name: str) -> DataFrame:
    """Predictions that name no catalogue entry."""
    return predictions.join(catalogue.select(F.col(name).alias(answer)).distinct(), answer, "left_anti")


def catalogue_ids(predictions: DataFrame, catalogue: DataFrame, answer: str, name: str, idx: str) -> DataFrame:
    """Adds the catalogue id of each answer and whether it is `valid`; the first entry of a repeated name counts."""
    ids = catalogue.groupBy(F.col(name).alias(answer)).agg(F.min(idx).alias(idx))
    return predictions.join(ids, answer, "left").withColumn("valid", F.col(idx).isNotNull())


def target_by_history(rows: DataFrame, prompt: str, history: str, target: str, seq: Sequence[str]) -> DataFrame:
    """The two-step prompt to history to target look-up with last-write-wins on both steps."""
    histories = last_wins(rows, prompt, seq, [history])
    targets = last_wins(rows, history, seq, [target])
    return histories.join(targets, history)


def _field(name: str):
    return lambda entry: entry[name]
