"""File writers. Large outputs stay partitioned folders; nothing is funnelled into one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.arrays import keep_last

# Headers and limits of the text formats.
COMPACT_HEADER = ("user_id:token", "item_id_list:token_seq", "item_id:token")
WINDOW_COLUMNS = (
    "user_id", "item_asins", "item_asin", "history_item_id", "item_id", "history_item_title", "item_title",
    "history_rating", "rating", "history_timestamp", "timestamp",
)


def _newest(history: str, newest: int | None) -> Column:
    return F.col(history) if newest is None else keep_last(history, newest)


def compact_rows(df: DataFrame, user: str, history: str, target: str, *extra: Column, newest: int | None = None) -> DataFrame:
    """Compact sample lines: the history ids (or the `newest` of them) joined by blanks."""
    ids = F.transform(_newest(history, newest), lambda x: x.cast("string"))
    return df.select(*extra, F.col(user).alias(COMPACT_HEADER[0]), F.array_join(ids, " ").alias(COMPACT_HEADER[1]),
                     F.col(target).alias(COMPACT_HEADER[2]))


def write_compact(df: DataFrame, path: str, user: str, history: str, target: str, split: str, newest: int | None = None) -> None:
    """One TSV folder per split, `split=<name>`, in one pass."""
    rows = compact_rows(df, user, history, target, F.col(split).alias("split"), newest=newest)
    rows.write.partitionBy("split").mode("overwrite").csv(path, sep="\t", header=True)


def write_compact_parquet(df: DataFrame, path: str, user: str, history: str, target: str, split: str, newest: int | None = None) -> None:
    df.select(F.col(split).alias("split"), F.col(user).alias("user_id"),
              _newest(history, newest).alias("item_id_list"), F.col(target).alias("item_id")
              ).write.partitionBy("split").mode("overwrite").parquet(path)


def list_text(values: Column) -> Column:
    """An array as list source text (JSON), readable by `read_sid_samples`."""
    return F.to_json(values)


def write_windows_csv(df: DataFrame, path: str, split: str) -> None:
    """The 11-column window table, one CSV folder per split; list columns as list text."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    cols = [list_text(F.col(c)).alias(c) if c in arrays else F.col(c) for c in WINDOW_COLUMNS]
    df.select(F.col(split).alias("split"), *cols).write.partitionBy("split").mode("overwrite").csv(
        path, header=True, quote='"', escape='"')


def write_sid_samples(df: DataFrame, path: str) -> None:
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    df.select(*[list_text(F.col(c)).alias(c) if c in arrays else F.col(c) for c in df.columns]).write.mode(
        "overwrite").csv(path, header=True, quote='"', escape='"')


def write_keyed_json_lines(df: DataFrame, path: str, key: Column, value: Column) -> None:
    """One {"key": ..., "value": ...} object per line, so the output stays splittable."""
    df.select(key.cast("string").alias("key"), value.alias("value")).write.mode("overwrite").json(path)


def review_key(user: str, item: str, ts: str) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[F.col(c).cast("string") for c in (user, item, ts)]), F.lit(")"))


def write_id_map(df: DataFrame, path: str, orig: str, idx: str) -> None:
    df.select(F.col(orig).cast("string"), F.col(idx)).write.mode("overwrite").csv(path, sep="\t", quote="")


def catalogue_rows(items: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, title, item_id) of items with a SID; a missing title reads Item_<id>."""
    title = F.coalesce("title", F.concat(F.lit("Item_"), F.col("item_id").cast("string")))
    return items.withColumn("title", title).join(sids, "item_id").select("sid", "title", "item_id")


def write_catalogue(items: DataFrame, sids: DataFrame, path: str) -> None:
    catalogue_rows(items, sids).write.mode("overwrite").csv(path, sep="\t", quote="")


def write_title_ids(items: DataFrame, path: str) -> None:
    """The older two-column form: title and id."""
    items.select("title", "item_id").write.mode("overwrite").csv(path, sep="\t", quote="")


def write_sid_index(df: DataFrame, path: str, item: str, tokens: str) -> None:
    write_keyed_json_lines(df, path, F.col(item), F.col(tokens))


def write_predictions(df: DataFrame, path: str) -> None:
    df.drop("dedup").write.mode("overwrite").json(path)


def typed_header(df: DataFrame, names: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Rename to `name:type` headers and drop columns that do not go out."""
    return df.drop(*drop).withColumnsRenamed(names)


def write_typed_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_codebooks(codebooks: DataFrame, codes: DataFrame, path: str) -> None:
    codebooks.write.partitionBy("level").mode("overwrite").parquet(f"{path}/codebooks")
    codes.write.mode("overwrite").parquet(f"{path}/codes")
