"""File readers. Every reader has a fixed schema, so no pass is spent on inference."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import schemas
from seqloom.functions.prompts import LIST_JSON, parse_list
from seqloom.functions.text import strip, title_present, title_strict, track_title
from seqloom.operators.aggregates import last_wins
from seqloom.sources import json_scan
from seqloom.sources.npy import open_store, read_npy  # noqa: F401


def _existing(spark: SparkSession, paths: Sequence[str]) -> str:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        if hpath.getFileSystem(conf).exists(hpath):
            return path
    raise FileNotFoundError(" or ".join(paths))


def read_reviews(spark: SparkSession, path: str | None = None, folder: str = "..", category: str = "") -> DataFrame:
    """JSON-lines reviews from `path`, else the dense 5-core file of the category, else its full file."""
    found = path or _existing(spark, [f"{folder}/{category}_5.json", f"{folder}/{category}.json"])
    return spark.read.schema(schemas.REVIEW).json(found)


def read_item_meta(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines metadata; list-valued fields stay raw JSON text for the cleaning functions."""
    return spark.read.schema(schemas.ITEM_META).json(path)


def valid_titles(meta: DataFrame, strict: bool = False) -> DataFrame:
    rule = title_strict("title") if strict else title_present("title")
    return meta.filter(rule).select("asin", strip(F.col("title")).alias("title"))


def invalid_items(meta: DataFrame, strict: bool = False) -> DataFrame:
    rule = title_strict("title") if strict else title_present("title")
    return meta.filter(~rule).select("asin").distinct()


def read_sequences(
    spark: SparkSession, path: str, split: str = "train", first: int | None = None, order: Sequence[str] = ("uid",)
) -> DataFrame:
    """User sequences: the `split` folder when there is one, plural column names, optionally the first n users by `order`.

    Files of `user_sequences` keep its `segment`; the segments of a user stay together.
    """
    try:
        found = _existing(spark, [f"{path}/{split}", path])
    except FileNotFoundError as e:
        raise AnalysisException(f"no sequences under {path}") from e
    df = spark.read.parquet(found).withColumnsRenamed({"item_id": "item_ids", "timestamp": "timestamps"})
    if first is None:
        return df
    if "segment" not in df.columns:
        return df.orderBy(*order).limit(first)
    return df.join(df.filter("segment = 0").orderBy(*order).limit(first).select("uid"), "uid", "left_semi")


def read_listens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LISTEN).parquet(path)


def listens_as_reviews(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Listen events in review shape: prefixed ids, a constant rating and review date, empty texts."""
    organic = F.coalesce("is_organic", F.lit(1)) if "is_organic" in events.columns else F.lit(1)
    return events.select(
        *keep, F.concat(F.lit("u_"), F.col("uid").cast("string")).alias("reviewerID"),
        F.concat(F.lit("i_"), F.col("item_id").cast("string")).alias("asin"), F.lit(5.0).alias("overall"),
        F.col("timestamp").alias("unixReviewTime"), F.lit("01 1, 2017").alias("reviewTime"),
        F.lit("").alias("summary"), F.lit("").alias("reviewText"), F.col("item_id").alias("orig_item_id"),
        organic.alias("is_organic"), "played_ratio_pct", "track_length_seconds", "event_type")


def bare_item_meta(reviews: DataFrame, seq: Sequence[str]) -> DataFrame:
    """One metadata row per item with a title from its length (last event wins) and empty text fields."""
    titled = reviews.withColumn("title", track_title(F.col("asin"), F.col("track_length_seconds")))
    return last_wins(titled, "asin", seq, ["title"]).select(
        "asin", "title", F.lit("").alias("description"), F.lit("").alias("brand"),
        F.array().cast("array<string>").alias("categories"))


def read_sid_samples(spark: SparkSession, path: str) -> DataFrame:
    """CSV samples whose list columns hold list source text; parsed as data, never evaluated."""
    raw = spark.read.schema(schemas.SID_SAMPLE_CSV).csv(path, header=True, multiLine=True, quote='"', escape='"')
    ids = F.from_json("history_item_id", "array<bigint>", LIST_JSON)
    return raw.withColumns({
        "history_item_title": parse_list("history_item_title"), "history_item_id": ids,
        "history_item_sid": parse_list("history_item_sid")})


def read_inter(spark: SparkSession, path: str, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected lines) of a compact TSV; a line must have exactly three fields. `numbered` adds each sample's place, `line`."""
    raw = spark.read.text(path)
    if numbered:
        from seqloom.operators.ranking import global_rank

        placed = raw.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                            F.monotonically_increasing_id().alias("__row"))
        raw = global_rank(placed, ["__file", "__block", "__row"], "line").select("value", F.col("line").alias("__line"))
    place = ["__line"] if numbered else []
    lines = raw.select(*place, strip(F.col("value")).alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("user_id:token"))
    fields = lines.select(*place, "line", F.split("line", "\t").alias("f"))
    history = F.filter(F.split(F.get("f", F.lit(1)), " "), lambda x: x != "")
    samples = fields.filter(F.size("f") == 3).select(
        F.get("f", F.lit(0)).cast("bigint").alias("user_id"),
        F.transform(history, lambda x: x.cast("bigint")).alias("item_id_list"),
        F.get("f", F.lit(2)).cast("bigint").alias("item_id"), *[F.col(c).alias("line") for c in place])
    return samples, fields.filter(F.size("f") != 3).select("line")


def read_keyed_json(spark: SparkSession, path: str, value_type: str, indent: int | None = None) -> DataFrame:
    """A JSON object of many keys as (key, value) rows.

    With the indent it was written with, the file is split where an entry's closing bracket
    stands on its own line (JSON text has no raw newlines), so it is read in parallel and no
    row holds the whole object. Without an indent the object may stand on one line; its entries
    are then found by a scan of quotes and brackets, in parallel too.
    """
    if indent is None:
        pair = r'(?s)^\s*("(?:[^"\\]|\\.)*")\s*:(.*)$'
        entry = json_scan.entries(spark, path)
        key = F.from_json(F.concat(F.lit("["), F.regexp_extract("entry", pair, 1), F.lit("]")), "array<string>")
        value = F.from_json(F.concat(F.lit('{"v":'), F.regexp_extract("entry", pair, 2), F.lit("}")), f"struct<v: {value_type}>")
        return entry.select(F.get(key, F.lit(0)).alias("key"), value["v"].alias("value"))
    close = "]" if value_type.lower().startswith("array") else "}"
    opener = {"]": "[", "}": "{"}[close]
    pieces = spark.read.text(path, lineSep="\n" + " " * indent + close)
    entry = r'(?s)"((?:[^"\\]|\\.)*)"\s*:\s*(\%s.*)$' % opener
    key = F.from_json(F.concat(F.lit('["'), F.regexp_extract("value", entry, 1), F.lit('"]')), "array<string>")
    body = F.concat(F.regexp_extract("value", entry, 2), F.lit(close))
    return pieces.filter(F.regexp_extract("value", entry, 2) != "").select(
        F.get(key, F.lit(0)).alias("key"), F.from_json(body, value_type).alias("value"))


def read_sid_index(spark: SparkSession, path: str, indent: int | None = 2) -> DataFrame:
    rows = read_keyed_json(spark, path, "array<string>", indent)
    return rows.select(F.col("key").cast("bigint").alias("item_id"), F.col("value").alias("tokens"),
                       F.array_join("value", "").alias("sid"))


def read_item_features(spark: SparkSession, path: str, indent: int | None = 2) -> DataFrame:
    return read_keyed_json(spark, path, schemas.ITEM_FEATURE, indent).select(F.col("key").cast("bigint").alias("item_id"), "value.*")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue TSV (sid, title, item id), in id order numbered as the catalogue id."""
    from seqloom.operators.ranking import dense_ids

    rows = spark.read.schema(schemas.CATALOGUE).csv(path, sep="\t", quote="")
    return dense_ids(rows, ["item_id", "sid"], "catalogue_id")


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ID_MAP).csv(path, sep="\t", quote="")


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """Preferences as JSON arrays or as JSON lines, each file told apart by its first character; arrays are read in parallel."""
    openers, starts = json_scan.file_forms(spark, path)
    arrays, lines = ([f for f, first in openers.items() if (first == "[") == wanted] for wanted in (True, False))
    found = []
    if lines:
        found.append(spark.read.schema(schemas.PREFERENCE).json(lines))
    if arrays:
        kind = schemas.PREFERENCE if isinstance(schemas.PREFERENCE, str) else schemas.PREFERENCE.simpleString()
        found.append(json_scan.entries(spark, arrays, starts).select(F.from_json("entry", kind).alias("p")).select("p.*"))
    rows = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schemas.PREFERENCE)
    return rows.select("user", "user_preference", "split", "context.*")


def preference_histories(rows: DataFrame) -> DataFrame:
    """Train preferences with at least two items: the target closes the history, then the last item is held out."""
    full = F.concat(F.coalesce("history_items", F.array().cast("array<bigint>")),
                    F.filter(F.array("target_item"), lambda x: x.isNotNull()))
    kept = rows.filter(F.col("split") == "train").withColumn("__all", full).filter(F.size("__all") >= 2)
    return kept.select("user", "user_preference", F.slice("__all", F.lit(1), F.size("__all") - 1).alias("history"),
                       F.element_at("__all", -1).alias("target"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """TSV with a `name:type` header; columns are read by position."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, enforceSchema=True)


def read_arrow_streams(spark: SparkSession, paths: Sequence[str] | DataFrame, schema: str) -> DataFrame:
    """Arrow IPC stream files, listed or in a table's column `file`: a task opens one after another and hands on its record batches."""

    def load(batches):
        import pyarrow.ipc as ipc

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = open_store(path)
                with system.open_input_stream(inner) as stream:
                    yield from ipc.open_stream(stream)

    files = paths.select("file") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "file string")
    return files.repartition(max(1, files.count()), "file").mapInArrow(load, schema)


def sanitized_stats(df: DataFrame, embedding: str) -> DataFrame:
    """Counts of NaN and infinite values and min, max, mean after they became 0."""
    from seqloom.functions.arrays import count_where, sanitize

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))

    clean = sanitize(embedding)
    return df.select(
        count_where(F.col(embedding), F.isnan).alias("nan"),
        count_where(F.col(embedding), lambda x: F.abs(x) == F.lit(float("inf"))).alias("inf"),
        F.array_min(clean).alias("lo"), F.array_max(clean).alias("hi"), total(clean).alias("sum"),
        F.size(embedding).alias("n"),
    ).agg(F.count(F.lit(1)).alias("rows"), F.sum("nan").alias("nan_values"), F.sum("inf").alias("inf_values"),
          F.min("lo").cast("double").alias("min"), F.max("hi").cast("double").alias("max"),
          (F.sum("sum") / F.sum("n")).alias("mean"))
