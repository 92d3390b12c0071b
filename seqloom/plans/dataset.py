"""From an interaction log to titled, split training windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.core import k_core
from seqloom.operators.lookups import item_features, review_texts, sid_samples
from seqloom.operators.ranking import item_ids_by_appearance, label_splits, split_cuts, user_ids_by_appearance
from seqloom.operators.sampling import sample_rows
from seqloom.operators.sequences import longest_history, sliding_windows, user_sequences
from seqloom.session import materialize
from seqloom.sources import writers
from seqloom.sources.readers import read_inter


def titled_windows(events: DataFrame, items: DataFrame, user: str, order: Sequence[str]) -> DataFrame:
    """Windows whose history and target carry id, title, SID, rating and time.

    Item columns join the single event before windows form, so no array is exploded and re-gathered.
    """
    titled = events.join(items, "item_id")
    carried = [c for c in ("item_id", "title", "sid", "rating", "ts") if c in titled.columns]
    # users are counted on the log alone, so the look-up join runs once
    return sliding_windows(titled, user, order, carried, counted=events.select(user))


def split_samples(
    events: DataFrame, user: str, order: Sequence[str], fields: Sequence[str],
    fractions: Sequence[float] = (0.8, 0.9),
) -> DataFrame:
    """Sliding windows labelled train, valid or test by global time order.

    The targets of the windows are all events but each user's first, so the cuts are found on
    the order columns of those alone. The wide windows are made once and go straight on.
    """
    firsts = events.groupBy(user).agg(F.min(F.struct(*order)).alias("__first"))
    targets = events.select(user, *order).join(firsts, user).filter(F.struct(*order) != F.col("__first"))
    keys = materialize(targets.select(*order), "targets")
    return label_splits(sliding_windows(events, user, order, fields), order, split_cuts(keys, order, fractions))


def dataset_from_log(
    events: DataFrame, user: str, item: str, order: Sequence[str], user_k: int, item_k: int | None = None,
    fields: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """A log to a dataset: k-core, dense ids by appearance, sliding windows split by time.

    `samples` has user_idx, item_idx, history (structs of item_idx and `fields`) and split; `users` and `items` map the ids;
    `numbered` is the core with both.
    The core and the numbered log are stored once, and every later step reads those.
    """
    kept = materialize(k_core(events, user, item, user_k, item_k), "kept")
    users = materialize(user_ids_by_appearance(kept, user, order), "users")
    items = materialize(item_ids_by_appearance(kept, user, item, order), "items")
    numbered = materialize(kept.join(users, user).join(items, item), "numbered")
    return {"samples": split_samples(numbered, "user_idx", order, ["item_idx", *fields]), "users": users, "items": items, "numbered": numbered}


def write_dataset(
    made: dict[str, DataFrame], path: str, order: Sequence[str], user: str, item: str, meta: DataFrame, meta_order: Sequence[str],
    review: str, summary: str,
) -> dict[str, str]:
    """All files of a dataset from `dataset_from_log`, by name: samples per split, id maps, sequences, item features, review texts.

    `meta` has asin, title, description, brand and categories (raw JSON text); its last row by `meta_order` counts. `review` and
    `summary` are text columns of the log. Files are folders that the tasks fill.
    """
    numbered = made["numbered"]
    files = {name: f"{path}/{name}" for name in ("samples", "users", "items", "sequences", "features", "reviews")}
    samples = made["samples"].withColumn("ids", F.col("history.item_idx"))
    writers.write_compact(samples, files["samples"], "user_idx", "ids", "item_idx", "split")
    writers.write_id_map(made["users"], files["users"], user, "user_idx")
    writers.write_id_map(made["items"], files["items"], item, "item_idx")
    segments = user_sequences(numbered, "user_idx", order, ["item_idx"])
    writers.write_keyed_json_lines(segments, files["sequences"], F.concat_ws("/", "user_idx", "segment"), F.col("sequence.item_idx"))
    known = made["items"].select(F.col(item).cast("string").alias("asin"), F.col("item_idx").alias("item_id"))
    features = item_features(known, meta, meta_order)
    writers.write_keyed_json_lines(features, files["features"], F.col("item_id"), F.struct("title", "description", "brand", "categories"))
    texts = review_texts(numbered, "user_idx", "item_idx", order[0], review, summary, order)
    writers.write_keyed_json_lines(texts, files["reviews"], writers.review_key("user_idx", "item_idx", order[0]), F.struct("review", "summary"))
    return files


def sid_samples_from_compact(
    spark: SparkSession, files: dict[str, str], items: DataFrame, sids: DataFrame, longest: Sequence[str] = ("train",),
    sampled: dict[str, int] | None = None, seed: int = 42,
) -> DataFrame:
    """SID samples of every split, column `split`, from compact files {split: path}.

    Splits in `longest` keep each user's longest history, the first line among equals; those in `sampled` keep that many lines,
    all others every line. `items` is (item_id, title), `sids` is (item_id, sid).
    """
    out = []
    for split, path in files.items():
        rows = read_inter(spark, path, numbered=True)[0]
        if split in longest:
            rows = longest_history(rows, "user_id", "item_id_list", "line", ["item_id_list", "item_id"])
        if sampled and split in sampled:
            rows = sample_rows(rows, ["line"], sampled[split], seed)
        rows = materialize(rows.select("line", "user_id", "item_id_list", "item_id"), f"lines-{split}")
        made = sid_samples(rows, ["line", "user_id", "item_id"], "item_id_list", "item_id", "user_id", items, sids)
        out.append(made.withColumn("split", F.lit(split)))
    return reduce(DataFrame.unionByName, out)
