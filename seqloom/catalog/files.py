"""Queries that write a file format and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import query, with_sql
from seqloom.catalog.inputs import CATALOGUE, HIST, LISTENS, catalogue, listens, table, wall_micros
from seqloom.catalog.interactions import SEGMENT_ROWS
from seqloom.functions import text
from seqloom.operators import sequences
from seqloom.operators.ranking import chronological_split
from seqloom.plans.dataset import split_samples, titled_windows
from seqloom.session import durable_path, materialize
from seqloom.sources import npy, readers, writers


def joined(col, sep=","):
    return F.array_join(F.col(col).cast("array<string>"), sep)


SPLIT_CTES = (f"""w AS MATERIALIZED (SELECT *, count(*) OVER x AS n, list(item_id) OVER x AS hi
   FROM listens WINDOW x AS (PARTITION BY uid ORDER BY ts, event_id {HIST}))""", """
   m AS MATERIALIZED (SELECT *, CASE WHEN r < CAST(floor(0.8 * t) AS BIGINT) THEN 'train' WHEN r < CAST(floor(0.9 * t) AS BIGINT) THEN 'valid' ELSE 'test' END AS split
     FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS t FROM w WHERE n > 0))""")


@query("compact_files", with_sql(LISTENS, *SPLIT_CTES, body="""
    SELECT split, uid AS user_id, array_to_string(hi, ' ') AS history, item_id FROM m"""))
def compact_files(spark, sf):
    """Compact TSV per split, then the strict reader."""
    marked = split_samples(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"]).withColumn("items", sequences.history_of("item_id"))
    path = durable_path(spark, "compact")
    writers.write_compact(marked, path, "uid", "items", "item_id", "split")
    parts = [readers.read_inter(spark, f"{path}/split={s}")[0].withColumn("split", F.lit(s)) for s in ("train", "valid", "test")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("split", "user_id", joined("item_id_list", " ").alias("history"), "item_id")


@query("compact_parquet", with_sql(LISTENS, *SPLIT_CTES, body="SELECT split, uid AS user_id, array_to_string(hi, ',') AS history, item_id FROM m"))
def compact_parquet(spark, sf):
    marked = split_samples(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"]).withColumn("items", sequences.history_of("item_id"))
    path = durable_path(spark, "compact")
    writers.write_compact_parquet(marked, path, "uid", "items", "item_id", "split")
    rows = spark.read.schema("user_id bigint, item_id_list array<bigint>, item_id bigint, split string").parquet(path)
    return rows.select("split", "user_id", joined("item_id_list").alias("history"), "item_id")


@query("window_files", with_sql(LISTENS, CATALOGUE, f"""w AS MATERIALIZED (SELECT * FROM (SELECT t.*, count(*) OVER x AS n, list(item_id) OVER x AS hi, list(title) OVER x AS ht
   FROM (SELECT listens.*, title FROM listens JOIN catalogue USING (item_id)) t WINDOW x AS (PARTITION BY uid ORDER BY ts, event_id {HIST})) WHERE n > 0)""", SPLIT_CTES[1].replace(" FROM w WHERE n > 0", " FROM w"), body="""
    SELECT split, CAST(uid AS VARCHAR) AS user_id, array_to_string(hi, ',') AS history_item_id, array_to_string(ht, '|') AS history_item_title, title AS item_title, item_id FROM m"""))
def window_files(spark, sf):
    """The 11-column CSV per split, read back with list columns parsed."""
    w = titled_windows(listens(spark, sf), catalogue(spark, sf).select("item_id", "title"), "uid", ["ts", "event_id"])
    h = sequences.history_of
    asin = F.transform(h("item_id"), lambda x: F.concat(F.lit("i_"), x.cast("string")))
    wide = w.select(F.col("uid").cast("string").alias("user_id"), asin.alias("item_asins"), F.concat(F.lit("i_"), F.col("item_id").cast("string")).alias("item_asin"),
                    h("item_id").alias("history_item_id"), "item_id", h("title").alias("history_item_title"), F.col("title").alias("item_title"),
                    F.transform(h("item_id"), lambda x: F.lit(5)).alias("history_rating"), F.lit(5).alias("rating"),
                    h("ts").alias("history_timestamp"), F.col("ts").alias("timestamp"), "event_id")
    marked = chronological_split(materialize(wide, "wide"), ["timestamp", "event_id"])
    path = durable_path(spark, "windows")
    writers.write_windows_csv(marked, path, "split")
    schema = ", ".join(f"{c} string" for c in writers.WINDOW_COLUMNS) + ", split string"
    from seqloom.functions.prompts import LIST_JSON, parse_list

    raw = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return raw.select("split", "user_id", F.array_join(F.from_json("history_item_id", "array<string>", LIST_JSON), ",").alias("history_item_id"),
                      F.array_join(parse_list("history_item_title"), "|").alias("history_item_title"), "item_title", F.col("item_id").cast("bigint").alias("item_id"))


@query("catalogue_file", with_sql(CATALOGUE, body="SELECT sid, title, item_id, row_number() OVER (ORDER BY item_id) - 1 AS catalogue_id FROM catalogue"))
def catalogue_file(spark, sf):
    cat, path = catalogue(spark, sf), durable_path(spark, "info")
    writers.write_catalogue(cat.select("item_id", "title"), cat.select("item_id", "sid"), path)
    return readers.read_catalogue(spark, path)


@query("id_map_file", "SELECT c_name AS orig, c_custkey AS idx FROM customer")
def id_map_file(spark, sf):
    path = durable_path(spark, "ids")
    writers.write_id_map(table(spark, sf, "customer"), path, "c_name", "c_custkey")
    return readers.read_id_map(spark, path)


@query("sid_index_file", with_sql(CATALOGUE, body="SELECT item_id, '<a_' || c1 || '> <b_' || c2 || '> <c_' || c3 || '>' AS tokens FROM catalogue"))
def sid_index_file(spark, sf):
    path = durable_path(spark, "index")
    writers.write_sid_index(catalogue(spark, sf), path, "item_id", "tokens")
    rows = readers.read_json_lines(spark, path, "key string, value array<string>")
    return rows.select(F.col("key").cast("bigint").alias("item_id"), F.array_join("value", " ").alias("tokens"))


@query("prediction_file", with_sql(LISTENS, CATALOGUE, body="SELECT 'u' || uid AS input, sid || chr(10) AS output, sid AS predict FROM listens JOIN catalogue USING (item_id)"))
def prediction_file(spark, sf):
    rows = listens(spark, sf).join(catalogue(spark, sf).select("item_id", "sid"), "item_id").select(
        F.concat(F.lit("u"), F.col("uid").cast("string")).alias("input"), F.concat("sid", F.lit("\n")).alias("output"), F.array("sid").alias("predict"), F.lit(False).alias("dedup"))
    path = durable_path(spark, "predictions")
    writers.write_predictions(rows, path)
    back = spark.read.schema("input string, output string, predict array<string>, dedup boolean").json(path)
    return back.filter(F.col("dedup").isNull()).select("input", "output", F.array_join("predict", ",").alias("predict"))


@query("typed_header_file", with_sql(LISTENS, body="SELECT uid, item_id, ts FROM listens"))
def typed_header_file(spark, sf):
    names = {"uid": "user_id:token", "item_id": "item_id:token", "ts": "timestamp:float"}
    path = durable_path(spark, "typed")
    writers.write_typed_tsv(writers.typed_header(listens(spark, sf), names, ["event_id", "event_type", "value"]), path)
    return readers.read_tsv(spark, path, "uid bigint, item_id bigint, ts bigint")


@query("sequence_folder", with_sql(LISTENS, body="""
    SELECT uid, array_to_string(list(item_id ORDER BY ts, event_id), ',') AS item_ids, array_to_string(list(ts ORDER BY ts, event_id), ',') AS timestamps
    FROM listens GROUP BY 1"""))
def sequence_folder(spark, sf):
    """Sequence Parquet with a train folder and singular names, written by segments of 30 rows and read back whole."""
    path = durable_path(spark, "seq")
    s = sequences.user_sequences(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id", "ts"], segment_rows=SEGMENT_ROWS)
    s.select("uid", "segment", F.col("sequence.item_id").alias("item_id"), F.col("sequence.ts").alias("timestamp")).write.parquet(f"{path}/train")
    rows = sequences.whole_sequences(readers.read_sequences(spark, path), "uid", "item_ids", "timestamps")
    return rows.select("uid", joined("item_ids").alias("item_ids"), joined("timestamps").alias("timestamps"))


@query("listen_scan", "SELECT user_id AS uid, event_id AS item_id, epoch_us(ts) AS timestamp FROM events WHERE value >= 20")
def listen_scan(spark, sf):
    path = durable_path(spark, "listens")
    table(spark, sf, "events").select(
        F.col("user_id").alias("uid"), F.col("event_id").alias("item_id"), wall_micros(F.col("ts")).alias("timestamp"), F.lit(1).alias("is_organic"),
        F.col("value").alias("played_ratio_pct"), F.lit(None).cast("int").alias("track_length_seconds"), "event_type").write.parquet(path)
    return readers.read_listens(spark, path).filter("played_ratio_pct >= 20").select("uid", "item_id", "timestamp")


@query("keyed_json_lines", "SELECT p_partkey AS item_id, p_name AS title, p_brand AS brand FROM part")
def keyed_json_lines(spark, sf):
    path = durable_path(spark, "items")
    parts = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_name").alias("title"), F.lit("").alias("description"), F.col("p_brand").alias("brand"), F.col("p_type").alias("categories")).alias("v"))
    writers.write_keyed_json_lines(parts, path, F.col("p_partkey"), F.col("v"))
    rows = readers.read_json_lines(spark, path, f"key string, value {readers.schemas.ITEM_FEATURE}")
    return rows.select(F.col("key").cast("bigint").alias("item_id"), "value.title", "value.brand")


@query("user_sequence_file", with_sql(LISTENS, body="""
    SELECT uid, array_to_string(list(item_id ORDER BY ts, event_id), ' ') AS items FROM listens GROUP BY 1"""))
def user_sequence_file(spark, sf):
    """One line per user with the whole sequence."""
    path = durable_path(spark, "user-items")
    segments = sequences.user_sequences(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"], segment_rows=SEGMENT_ROWS)
    s = sequences.whole_sequences(segments, "uid")
    writers.write_keyed_json_lines(s, path, F.col("uid"), F.col("sequence.item_id"))
    rows = readers.read_json_lines(spark, path, "key string, value array<bigint>")
    return rows.select(F.col("key").cast("bigint").alias("uid"), joined("value", " ").alias("items"))


@query("review_text_file", "SELECT '(' || user_id || ', ' || event_id || ', ' || epoch_us(ts) || ')' AS key, event_type AS review FROM events")
def review_text_file(spark, sf):
    path = durable_path(spark, "reviews")
    rows = listens(spark, sf).withColumn("key", writers.review_key("uid", "event_id", "ts"))
    writers.write_keyed_json_lines(rows, path, F.col("key"), F.struct(F.col("event_type").alias("review"), F.lit("").alias("summary")))
    back = readers.read_json_lines(spark, path, "key string, value struct<review: string, summary: string>")
    return back.select("key", "value.review")


@query("codebook_files", """
    SELECT CAST(label AS BIGINT) AS code, CAST(d AS BIGINT) AS d, round(avg(x), 6) AS x FROM (
      SELECT label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2""")
def codebook_files(spark, sf):
    from seqloom.operators import quantize

    e = table(spark, sf, "embeddings")
    books = quantize.mean_vectors(e.withColumn("vec", F.col("embedding").cast("array<double>")), "label", "vec").select(
        F.lit(0).alias("level"), F.col("label").cast("int").alias("code"), "centroid")
    path = durable_path(spark, "books")
    writers.write_codebooks(books, e.select(F.col("vec_id").alias("item_id"), F.array("label").alias("codes")), path)
    back = spark.read.schema("code int, centroid array<double>, level int").parquet(f"{path}/codebooks")
    flat = back.select(F.col("code").cast("bigint").alias("code"), F.posexplode("centroid").alias("p", "x"))
    return flat.select("code", (F.col("p") + 1).cast("bigint").alias("d"), F.round("x", 6).alias("x"))


# ---- readers: the given tables written in each format by Spark, then read with the reader ----
@query("review_json", with_sql(LISTENS, body="""
    SELECT 'u' || uid AS reviewer, CAST(item_id AS VARCHAR) AS asin, round(value, 6) AS overall, ts AS time, event_type AS review FROM listens"""))
def review_json(spark, sf):
    path = durable_path(spark, "reviews")
    rows = listens(spark, sf)
    rows.select(F.concat(F.lit("u"), F.col("uid").cast("string")).alias("reviewerID"), F.col("item_id").cast("string").alias("asin"), F.col("value").alias("overall"),
                F.col("ts").alias("unixReviewTime"), F.col("event_type").alias("reviewText"), F.lit("more").alias("style")).write.json(f"{path}/x_5.json")
    back = readers.read_reviews(spark, folder=path, category="x")
    return back.select(F.col("reviewerID").alias("reviewer"), "asin", F.round("overall", 6).alias("overall"), F.col("unixReviewTime").alias("time"), F.col("reviewText").alias("review"))


@query("metadata_json", """
    SELECT CAST(p_partkey AS VARCHAR) AS asin, p_name AS title, p_brand || ',' || p_type AS categories FROM part WHERE p_size % 3 > 0""")
def metadata_json(spark, sf):
    """Metadata lines with nested categories; blank titles fall to the lenient title rule."""
    path = durable_path(spark, "metadata")
    part = table(spark, sf, "part")
    part.select(F.col("p_partkey").cast("string").alias("asin"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).otherwise("  ").alias("title"),
                F.array(F.array(F.lit("x</span>"), F.col("p_brand")), F.array("p_type")).alias("categories")).write.json(path)
    meta = readers.read_item_meta(spark, path)
    named = meta.select("asin", text.join_categories(text.parse_categories("categories")).alias("categories"))
    return readers.valid_titles(meta).join(named, "asin")


@query("sid_sample_csv", with_sql(LISTENS, *SPLIT_CTES, body="""
    SELECT uid || '' AS user_id, array_to_string(hi, ',') AS history_item_id, item_id, 'a, "b" ' || array_to_string(hi, '|a, "b" ') AS titles FROM m"""))
def sid_sample_csv(spark, sf):
    """Samples whose list columns are list text with quotes and commas inside."""
    path = durable_path(spark, "samples")
    w = sequences.sliding_windows(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"])
    ids = sequences.history_of("item_id")
    titles = F.transform(ids, lambda i: F.concat(F.lit('a, "b" '), i.cast("string")))
    writers.write_sid_samples(w.select(F.col("uid").cast("string").alias("user_id"), titles.alias("history_item_title"), F.lit("t").alias("item_title"),
                                       ids.alias("history_item_id"), "item_id", titles.alias("history_item_sid"), F.lit("s").alias("item_sid")), path)
    back = readers.read_sid_samples(spark, path)
    return back.select("user_id", joined("history_item_id").alias("history_item_id"), "item_id", F.array_join("history_item_title", "|").alias("titles"))


@query("keyed_json_object", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS title, p_brand AS brand FROM part")
def keyed_json_object(spark, sf):
    """One JSON object of all items, indented, so that it is read in pieces."""
    path = durable_path(spark, "object")
    entry = F.concat(F.lit("  "), F.to_json(F.array(F.col("p_partkey").cast("string"))), F.lit(": {\n    "), F.lit('"title": '),
                     F.to_json(F.array("p_name")), F.lit(',\n    "brand": '), F.to_json(F.array("p_brand")), F.lit("\n  }"))
    # to_json of a one-element array, without its brackets, is a quoted value
    table(spark, sf, "part").select(F.regexp_replace(entry, r'\["((?:[^"\\\\]|\\\\.)*)"\]', '"$1"').alias("value")).write.text(path)
    rows = readers.read_keyed_json(spark, path, "struct<title: string, brand: string>", indent=2)
    return rows.select("key", "value.title", "value.brand")


@query("keyed_json_one_line", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS title, 'a \"b\", {' || p_brand || '}, [' AS brand FROM part")
def keyed_json_one_line(spark, sf):
    """The same object without line feeds: one file of entries between commas, found by a scan of quotes and brackets."""
    path = durable_path(spark, "line")
    value = F.to_json(F.struct(F.col("p_name").alias("title"), F.concat(F.lit('a "b", {'), "p_brand", F.lit("}, [")).alias("brand"), F.array("p_size", "p_size").alias("sizes")))
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit('"'), F.col("p_partkey").cast("string"), F.lit('":'), value).alias("e"))
    entries = rows.select(F.concat("e", F.lit(",")).alias("e"))
    entries.mapInArrow(closed_objects, "e string").write.option("lineSep", " ").text(path)
    return readers.read_keyed_json(spark, path, "struct<title: string, brand: string>").where("key <> 'end'").select("key", "value.title", "value.brand")


def closed_objects(batches):
    """The text of each partition as one object: opened before its first entry, closed by a last one."""
    import pyarrow as pa

    some = False
    for batch in batches:
        if batch.num_rows and not some:
            some = True
            yield pa.RecordBatch.from_arrays([pa.array(["{"])], ["e"])
        yield batch
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(['"end":null}'])], ["e"])


@query("npy_vectors", """
    SELECT vec_id AS item_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS by_row, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS by_column,
           CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings""")
def npy_vectors(spark, sf):
    """Vectors as array files of ranges of ids, written and read by tasks, row-major and column-major."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0]
    back = [npy.read_npy_files(npy.write_npy_files(vectors, "item_id", "embedding", dim or 1, by_column)) for by_column in (False, True)]
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    rows = back[0].select("item_id", total.alias("by_row"), F.get("embedding", F.lit(0)).cast("double").alias("first"))
    return rows.join(back[1].select("item_id", total.alias("by_column"), F.element_at("embedding", -1).cast("double").alias("last")), "item_id")


@query("preference_json", with_sql(LISTENS, """u AS (SELECT uid, list(item_id ORDER BY ts, event_id) AS i FROM listens GROUP BY uid)""", body="""
    SELECT 'u' || uid AS "user", array_to_string(i[1:-2], ',') AS history, i[-1] AS target FROM u WHERE len(i) >= 2 AND uid % 3 > 0"""))
def preference_json(spark, sf):
    path = durable_path(spark, "preferences")
    s = sequences.user_sequences(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"])
    s = sequences.whole_sequences(s, "uid").withColumn("i", F.col("sequence.item_id"))
    s.select(F.concat(F.lit("u"), F.col("uid").cast("string")).alias("user"), F.lit("likes").alias("user_preference"),
             F.when(F.col("uid") % 3 > 0, "train").otherwise("test").alias("split"),
             F.struct(F.slice("i", F.lit(1), F.size("i") - 1).alias("history_items"), F.element_at("i", -1).alias("target_item")).alias("context")).write.json(path)
    rows = readers.preference_histories(readers.read_preferences(spark, path))
    return rows.select("user", joined("history").alias("history"), "target")


@query("arrow_streams", "SELECT vec_id AS item_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def arrow_streams(spark, sf):
    """Vectors written by the tasks as Arrow stream files, one per partition, and read stream by stream."""
    path = durable_path(spark, "streams")

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs, ipc

        store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(root, recursive=True)
        name, writer = f"{uuid.uuid4().hex}.arrow", None
        for batch in batches:
            if writer is None:
                sink = store.open_output_stream(f"{root}/{name}")
                writer = ipc.new_stream(sink, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"])], names=["file"])

    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    manifest = materialize(vectors.mapInArrow(write, "file string"), "files")
    rows = readers.read_arrow_streams(spark, manifest, "item_id bigint, embedding array<float>")
    return rows.select("item_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))

