"""Queries over the interaction log: core filtering, windows, splits, ids, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.catalog.base import query, with_sql
from seqloom.catalog.inputs import (
    CATALOGUE, HIST, LISTENS, PURCHASE_ORDER, PURCHASES, ROUND_ORDER, catalogue, core_ctes, listens, purchases, table,
)
from seqloom.functions import tables, text
from seqloom.operators import aggregates, core, ranking, sampling, sequences
from seqloom.plans import dataset
from seqloom.session import durable_path, materialize
from seqloom.sources import readers, writers

P_KEYS = ["order_id", "line_no", "item_id", "supp_id"]
HASH = "CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def hash_sql(*cols: str, seed: int = 42) -> str:
    return HASH.format(text=" || '|' || ".join([f"CAST({c} AS VARCHAR)" for c in cols] + [f"'{seed}'"]))


# ---- k-core (A1, A1b, F9, A2, A3) ----
@query("core_listens", with_sql(LISTENS, *core_ctes("listens", "uid", "item_id", 50, 80, 10),
                                body="SELECT event_id, uid, item_id, ts FROM core"))
def core_listens(spark, sf):
    return core.k_core(listens(spark, sf), "uid", "item_id", 50, 80).select("event_id", "uid", "item_id", "ts")


@query("core_purchases", with_sql(PURCHASES, *core_ctes("purchases", "user_id", "item_id", 20, 20, 10),
                                  body="SELECT user_id, item_id, ts, order_id, line_no, supp_id FROM core"))
def core_purchases(spark, sf):
    return core.k_core(purchases(spark, sf), "user_id", "item_id", 20).select(
        "user_id", "item_id", "ts", "order_id", "line_no", "supp_id")


@query("core_items_first", with_sql(
    PURCHASES, *core_ctes("purchases", "user_id", "item_id", 22, 19, 10, items_first=True),
    body="SELECT user_id, item_id, order_id, line_no, supp_id FROM core"))
def core_items_first(spark, sf):
    return core.k_core(purchases(spark, sf), "user_id", "item_id", 22, 19, items_first=True).select(
        "user_id", "item_id", "order_id", "line_no", "supp_id")


@query("core_allowed_items", with_sql(
    PURCHASES, "allowed AS (SELECT * FROM purchases WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size <= 40))",
    *core_ctes("allowed", "user_id", "item_id", 15, 15, 10),
    body="SELECT user_id, item_id, order_id, line_no, supp_id FROM core"))
def core_allowed_items(spark, sf):
    allowed = table(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("item_id"))
    return core.k_core(purchases(spark, sf), "user_id", "item_id", 15, allowed_items=allowed).select(
        "user_id", "item_id", "order_id", "line_no", "supp_id")


def _year_sql(year: int) -> list[str]:
    source = f"from{year} AS (SELECT * FROM purchases WHERE ts >= CAST(epoch(TIMESTAMP '{year}-01-01') AS BIGINT))"
    return [source, *core_ctes(f"from{year}", "user_id", "item_id", 8, 8, 14, out=f"core{year}", prefix=f"y{year}_")]


@query("core_adaptive_window", with_sql(
    PURCHASES, *[c for y in (2000, 1999, 1998, 1997) for c in _year_sql(y)],
    "sizes AS (" + " UNION ALL ".join(
        f"SELECT {y} AS y, count(DISTINCT item_id) AS n FROM core{y}" for y in (2000, 1999, 1998, 1997)) + ")",
    "pick AS (SELECT max(y) AS y FROM sizes WHERE n >= 1900)",
    body="SELECT order_id, line_no, item_id, supp_id, CAST(y AS BIGINT) AS start_year FROM (" + " UNION ALL ".join(
        f"SELECT {y} AS yy, order_id, line_no, item_id, supp_id FROM core{y}" for y in (2000, 1999, 1998, 1997))
    + ") JOIN pick ON yy = y"))
def core_adaptive_window(spark, sf):
    rows = purchases(spark, sf)

    def load(year):
        return rows.filter(F.col("ts") >= text.month_start(F.lit(year), F.lit(1)))

    kept, year = core.adaptive_window_core(load, "user_id", "item_id", 8, 2000, min_items=1900)
    return kept.select(*P_KEYS, F.lit(year).cast("bigint").alias("start_year"))


@query("core_adaptive_k", with_sql(
    PURCHASES, *core_ctes("purchases", "user_id", "item_id", 18, 18, 8, True, "k0", "k0_"),
    *[c for i in range(1, 5) for c in core_ctes(f"k{i-1}", "user_id", "item_id", 18 + i, 18 + i, 10, True, f"k{i}", f"k{i}_")],
    "sizes AS (" + " UNION ALL ".join(f"SELECT {i} AS i, count(DISTINCT item_id) AS n FROM k{i}" for i in range(5)) + ")",
    "pick AS (SELECT min(i) AS i FROM sizes WHERE n <= 1950)",
    body="SELECT order_id, line_no, item_id, supp_id, CAST(18 + i AS BIGINT) AS final_k FROM ("
    + " UNION ALL ".join(f"SELECT {i} AS j, order_id, line_no, item_id, supp_id FROM k{i}" for i in range(5))
    + ") JOIN pick ON j = i"))
def core_adaptive_k(spark, sf):
    kept, user_k, _ = core.adaptive_k_core(purchases(spark, sf), "user_id", "item_id", 18, 18, max_items=1950)
    return kept.select(*P_KEYS, F.lit(user_k).cast("bigint").alias("final_k"))


@query("density", with_sql(PURCHASES, body="""
    SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS interactions,
           round(count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 10) AS density FROM purchases"""))
def density(spark, sf):
    return core.density(purchases(spark, sf), "user_id", "item_id").withColumn("density", F.round("density", 10))


# ---- windows and splits (W1, W2, W3, W13, T1, A17) ----
W_LISTENS = f"""windows AS MATERIALIZED (SELECT *, count(*) OVER w AS hist_n,
   array_to_string(list(item_id) OVER w, ',') AS history_items, array_to_string(list(ts) OVER w, ',') AS history_ts
   FROM {{src}} WINDOW w AS (PARTITION BY uid ORDER BY ts {HIST}))"""


@query("windows_listens", with_sql(LISTENS, W_LISTENS.format(src="listens"), body="""
    SELECT event_id, uid, item_id, ts, history_items, history_ts FROM windows WHERE hist_n > 0"""))
def windows_listens(spark, sf):
    w = sequences.sliding_windows(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id", "ts"])
    return w.select("event_id", "uid", "item_id", "ts",
                    F.array_join(sequences.history_of("item_id").cast("array<string>"), ",").alias("history_items"),
                    F.array_join(sequences.history_of("ts").cast("array<string>"), ",").alias("history_ts"))


@query("windows_by_table_function", with_sql(LISTENS, W_LISTENS.format(src="listens"), body="""
    SELECT event_id, uid, item_id, history_items FROM windows WHERE hist_n > 0"""))
def windows_by_table_function(spark, sf):
    """The same windows from SQL: a table function that walks each user's rows in order."""
    tables.register(spark)
    return spark.sql("""
        SELECT event_id, uid, item_id, array_join(CAST(history AS ARRAY<STRING>), ',') AS history_items
        FROM history_windows(TABLE(SELECT * FROM {log}) PARTITION BY uid ORDER BY (ts, event_id))""", log=listens(spark, sf).select("uid", "event_id", "item_id", "ts"))


W_PURCHASES = f"""pw AS MATERIALIZED (SELECT *, count(*) OVER w AS hist_n, list(item_id) OVER w AS hist_items,
   list(CAST(rating AS BIGINT)) OVER w AS hist_ratings, list(ts) OVER w AS hist_ts
   FROM purchases WINDOW w AS (PARTITION BY user_id ORDER BY {ROUND_ORDER} {HIST}))"""


@query("windows_purchases", with_sql(PURCHASES, CATALOGUE, f"""titled AS (
    SELECT purchases.*, title, sid FROM purchases JOIN catalogue USING (item_id))""", f"""pw AS (
    SELECT *, count(*) OVER w AS hist_n, list(item_id) OVER w AS hi, list(CAST(rating AS BIGINT)) OVER w AS hr,
           list(ts) OVER w AS ht, list(title) OVER w AS hn, list(sid) OVER w AS hs
    FROM titled WINDOW w AS (PARTITION BY user_id ORDER BY {ROUND_ORDER} {HIST}))""", body="""
    SELECT user_id, order_id, line_no, supp_id, item_id, title, sid, CAST(rating AS BIGINT) AS rating, ts,
           array_to_string(hi, ',') AS history_item_id, array_to_string(hr, ',') AS history_rating,
           array_to_string(ht, ',') AS history_timestamp, array_to_string(hn, '|') AS history_item_title,
           array_to_string(hs, ' ') AS history_item_sid
    FROM pw WHERE hist_n > 0"""))
def windows_purchases(spark, sf):
    w = dataset.titled_windows(purchases(spark, sf), catalogue(spark, sf).select("item_id", "title", "sid"),
                               "user_id", PURCHASE_ORDER)

    def joined(field, sep=","):
        values = sequences.history_of(field)
        values = F.transform(values, lambda x: x.cast("bigint")) if field == "rating" else values
        return F.array_join(values.cast("array<string>"), sep)

    return w.select(
        "user_id", "order_id", "line_no", "supp_id", "item_id", "title", "sid", F.col("rating").cast("bigint").alias("rating"),
        "ts", joined("item_id").alias("history_item_id"), joined("rating").alias("history_rating"),
        joined("ts").alias("history_timestamp"), joined("title", "|").alias("history_item_title"),
        joined("sid", " ").alias("history_item_sid"))


SPLIT = """{out} AS MATERIALIZED (SELECT *, CASE WHEN r < CAST(floor(0.8 * n) AS BIGINT) THEN 'train'
    WHEN r < CAST(floor(0.9 * n) AS BIGINT) THEN 'valid' ELSE 'test' END AS split FROM (
    SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS r, count(*) OVER () AS n FROM {src}))"""


@query("split_by_time", with_sql(
    LISTENS, "later AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts, event_id) AS i FROM listens)",
    "samples AS (SELECT event_id, uid, item_id, ts FROM later WHERE i > 1)",
    SPLIT.format(out="marked", order="ts, event_id", src="samples"),
    body="SELECT event_id, uid, item_id, ts, split FROM marked"))
def split_by_time(spark, sf):
    return dataset.split_samples(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"]).select(
        "event_id", "uid", "item_id", "ts", "split")


@query("core_window_split_summary", with_sql(
    LISTENS, *core_ctes("listens", "uid", "item_id", 10, 10, 6),
    "later AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts, event_id) AS i FROM core)",
    "samples AS (SELECT * FROM later WHERE i > 1)", SPLIT.format(out="marked", order="ts, event_id", src="samples"),
    body="SELECT split, count(*) AS samples, count(DISTINCT uid) AS users, count(DISTINCT item_id) AS items "
         "FROM marked GROUP BY split"))
def core_window_split_summary(spark, sf):
    """Flagship: log, 10-core, sliding windows, 8:1:1 split by time, rows per split."""
    kept = core.k_core(listens(spark, sf), "uid", "item_id", 10)
    marked = dataset.split_samples(kept, "uid", ["ts", "event_id"], ["item_id", "ts"])
    return aggregates.split_summary(marked, "uid", "item_id", "split")


DATASET = (
    LISTENS, *core_ctes("listens", "uid", "item_id", 10, 10, 6),
    "users AS (SELECT uid, row_number() OVER (ORDER BY min(ts), uid) - 1 AS user_idx FROM core GROUP BY uid)",
    "walk AS (SELECT item_id, row_number() OVER (ORDER BY user_idx, ts, event_id) AS r FROM core JOIN users USING (uid))",
    "items AS (SELECT item_id, row_number() OVER (ORDER BY min(r)) - 1 AS item_idx FROM walk GROUP BY item_id)",
    "numbered AS (SELECT * FROM core JOIN users USING (uid) JOIN items USING (item_id))",
    """later AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY ts, event_id) AS i,
      list(item_idx) OVER (PARTITION BY user_idx ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h FROM numbered)""",
    "samples AS (SELECT * FROM later WHERE i > 1)", SPLIT.format(out="marked", order="ts, event_id", src="samples"))


@query("dataset_from_log", with_sql(*DATASET, body="SELECT split, user_idx, item_idx, event_id, array_to_string(h, ',') AS history FROM marked"))
def dataset_from_log(spark, sf):
    """Log to numbered, split training samples as one plan."""
    made = dataset.dataset_from_log(listens(spark, sf), "uid", "item_id", ["ts", "event_id"], 10)["samples"]
    history = F.array_join(F.transform("history", lambda h: h["item_idx"].cast("string")), ",")
    return made.select("split", "user_idx", "item_idx", "event_id", history.alias("history"))


@query("dataset_files", with_sql(*DATASET, body="""
    SELECT split AS file, CAST(user_idx AS VARCHAR) AS key, array_to_string(h, ' ') || ' > ' || item_idx AS value FROM marked
    UNION ALL SELECT 'users', CAST(uid AS VARCHAR), CAST(user_idx AS VARCHAR) FROM users
    UNION ALL SELECT 'items', CAST(item_id AS VARCHAR), CAST(item_idx AS VARCHAR) FROM items
    UNION ALL SELECT 'sequences', user_idx || '/0', string_agg(item_idx, ' ' ORDER BY ts, event_id) FROM numbered GROUP BY user_idx
    UNION ALL SELECT 'features', CAST(item_idx AS VARCHAR), p_name || '; ' || p_brand || '; ' || p_type FROM items JOIN part ON p_partkey = item_id
    UNION ALL SELECT 'reviews', '(' || user_idx || ', ' || item_idx || ', ' || ts || ')', arg_max(event_type, event_id) FROM numbered GROUP BY user_idx, item_idx, ts"""))
def dataset_files(spark, sf):
    """Log to all files of a dataset, and every line of them read back."""
    log = listens(spark, sf).withColumn("summary", F.lit(""))
    made = dataset.dataset_from_log(log, "uid", "item_id", ["ts", "event_id"], 10)
    meta = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("asin"), F.col("p_name").alias("title"), F.lit("").alias("description"),
                                           F.col("p_brand").alias("brand"), F.to_json(F.array("p_type")).alias("categories"), F.lit(0).alias("seq"))
    files = dataset.write_dataset(made, durable_path(spark, "dataset"), ["ts", "event_id"], "uid", "item_id", meta, ["seq"], "event_type", "summary")

    def rows(name, df, key, value):
        return df.select(F.lit(name).alias("file"), F.col(key).cast("string").alias("key"), value.cast("string").alias("value"))

    ids = "key string, value bigint"
    parts = [rows(name, spark.read.schema(ids).csv(files[name], sep="\t"), "key", F.col("value")) for name in ("users", "items")]
    for split in ("train", "valid", "test"):
        samples = readers.read_inter(spark, f"{files['samples']}/split={split}")[0]
        parts.append(rows(split, samples, "user_id", F.concat(F.array_join(F.col("item_id_list").cast("array<string>"), " "), F.lit(" > "), "item_id")))
    sequences_ = readers.read_json_lines(spark, files["sequences"], "key string, value array<string>")
    parts.append(rows("sequences", sequences_, "key", F.array_join("value", " ")))
    features = readers.read_json_lines(spark, files["features"], "key string, value struct<title: string, brand: string, categories: string>")
    parts.append(rows("features", features, "key", F.concat_ws("; ", "value.title", "value.brand", "value.categories")))
    parts.append(rows("reviews", readers.read_json_lines(spark, files["reviews"], "key string, value struct<review: string>"), "key", F.col("value.review")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("sid_samples_from_files", with_sql(LISTENS, CATALOGUE, "w AS (SELECT *, count(*) OVER x AS n, list(item_id) OVER x AS hi FROM listens WINDOW x AS (PARTITION BY uid ORDER BY ts, event_id "
    + HIST + "))", "m AS (SELECT * FROM w WHERE n > 0)", SPLIT.format(out="marked", order="ts, event_id", src="(SELECT * EXCLUDE (n), n AS len FROM m)"), """
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, split ORDER BY len DESC, ts, event_id) AS rn FROM marked) WHERE split <> 'train' OR rn = 1)""",
    "flat AS (SELECT event_id, unnest(hi) AS h, generate_subscripts(hi, 1) AS p FROM kept)",
    "hist AS (SELECT event_id, string_agg(c.sid, ' ' ORDER BY p) AS hs, string_agg(c.title, '|' ORDER BY p) AS ht FROM flat JOIN catalogue c ON h = c.item_id GROUP BY 1)", body="""
    SELECT split, 'A' || uid AS user_id, item_id, c.sid AS item_sid, c.title AS item_title, array_to_string(hi, ',') AS history_item_id,
           coalesce(hs, '') AS history_item_sid, coalesce(ht, '') AS history_item_title
    FROM kept JOIN catalogue c USING (item_id) LEFT JOIN hist USING (event_id)"""))
def sid_samples_from_files(spark, sf):
    """Compact files in time order to SID samples: each user's longest history for training, all lines of the other splits."""
    path = durable_path(spark, "compact")
    marked = materialize(dataset.split_samples(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"]), "marked")
    files = {split: f"{path}/{split}" for split in ("train", "valid", "test")}
    for split, folder in files.items():
        rows = marked.filter(F.col("split") == split).orderBy("ts", "event_id").withColumn("ids", F.col("history.item_id"))
        writers.compact_rows(rows, "uid", "ids", "item_id").write.csv(folder, sep="\t", header=True)
    cat = catalogue(spark, sf)
    out = dataset.sid_samples_from_compact(spark, files, cat.select("item_id", "title"), cat.select("item_id", "sid"))
    text_of = {c: F.array_join(F.col(c).cast("array<string>"), sep) for c, sep in (("history_item_id", ","), ("history_item_sid", " "), ("history_item_title", "|"))}
    return out.drop("line").withColumns(text_of)


@query("split_purchases", with_sql(
    PURCHASES, f"later AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {ROUND_ORDER}) AS i FROM purchases)",
    "samples AS (SELECT * FROM later WHERE i > 1)", SPLIT.format(out="marked", order=ROUND_ORDER, src="samples"),
    body="SELECT user_id, order_id, line_no, item_id, supp_id, split FROM marked"))
def split_purchases(spark, sf):
    return dataset.split_samples(purchases(spark, sf), "user_id", PURCHASE_ORDER, ["item_id"]).select(
        "user_id", *P_KEYS, "split")


@query("contiguous_shards", with_sql(LISTENS, body="""
    SELECT event_id, r AS "row", CAST(((r + 1) * 8 - 1) // n AS BIGINT) AS shard FROM (
      SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM listens)"""))
def contiguous_shards(spark, sf):
    return ranking.contiguous_shards(listens(spark, sf).select("event_id"), ["event_id"], 8)


@query("time_order_rank", with_sql(PURCHASES, body=f"""
    SELECT order_id, line_no, item_id, supp_id, row_number() OVER (ORDER BY {ROUND_ORDER}) - 1 AS rank FROM purchases"""))
def time_order_rank(spark, sf):
    return ranking.global_rank(purchases(spark, sf).select(*PURCHASE_ORDER), PURCHASE_ORDER).select(*P_KEYS, "rank")


@query("user_time_order", with_sql(LISTENS, body="""
    SELECT event_id, uid, row_number() OVER (PARTITION BY uid ORDER BY ts, event_id) - 1 AS pos FROM listens"""))
def user_time_order(spark, sf):
    return ranking.position_in_key(listens(spark, sf).select("event_id", "uid", "ts"), ["uid"], ["ts", "event_id"]).drop("ts")


@query("raw_user_order", with_sql(PURCHASES, body=f"""
    SELECT user_id, item_id, rating, ts, order_id, line_no, supp_id, row_number() OVER (PARTITION BY user_id ORDER BY {ROUND_ORDER}) - 1 AS place FROM purchases"""))
def raw_user_order(spark, sf):
    """Rows as they are laid out, with the place each has among its user's rows there."""
    laid = sequences.order_within_users(purchases(spark, sf), "user_id", PURCHASE_ORDER).withColumn("at", F.monotonically_increasing_id())
    laid = materialize(laid, "laid-out")
    return laid.withColumn("place", (F.row_number().over(Window.partitionBy("user_id").orderBy("at")) - 1).cast("bigint")).drop("at")


# ---- dense ids (W7a-c, SNK3) ----
@query("user_ids_by_appearance", with_sql(LISTENS, body="""
    SELECT uid, row_number() OVER (ORDER BY f, uid) - 1 AS user_idx FROM (SELECT uid, min(ts) AS f FROM listens GROUP BY 1)"""))
def user_ids_by_appearance(spark, sf):
    return ranking.user_ids_by_appearance(listens(spark, sf), "uid", ["ts", "event_id"])


@query("item_ids_by_appearance", with_sql(
    LISTENS, "users AS (SELECT uid, row_number() OVER (ORDER BY min(ts), uid) AS u FROM listens GROUP BY uid)",
    "walk AS (SELECT item_id, row_number() OVER (ORDER BY u, ts, event_id) AS r FROM listens JOIN users USING (uid))",
    body="SELECT item_id, row_number() OVER (ORDER BY min(r)) - 1 AS item_idx FROM walk GROUP BY item_id"))
def item_ids_by_appearance(spark, sf):
    return ranking.item_ids_by_appearance(listens(spark, sf), "uid", "item_id", ["ts", "event_id"])


@query("ids_by_text_key", with_sql(PURCHASES, body="""
    SELECT user_id, row_number() OVER (ORDER BY CAST(user_id AS VARCHAR)) - 1 AS idx FROM (SELECT DISTINCT user_id FROM purchases)"""))
def ids_by_text_key(spark, sf):
    return ranking.ids_by_key(purchases(spark, sf), "user_id", "idx", as_text=True)


@query("ids_by_native_key", with_sql(PURCHASES, body="""
    SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM purchases)"""))
def ids_by_native_key(spark, sf):
    return ranking.ids_by_key(purchases(spark, sf), "item_id", "idx")


@query("ids_by_shuffle", with_sql(PURCHASES, body=f"""
    SELECT item_id, row_number() OVER (ORDER BY {hash_sql('item_id')}, item_id) - 1 AS idx
    FROM (SELECT DISTINCT item_id FROM purchases)"""))
def ids_by_shuffle(spark, sf):
    return ranking.ids_by_shuffle(purchases(spark, sf), "item_id", "idx")


# ---- sequences (A4, A6, A7, A16, F7, F8, J2) ----
SEGMENT_ROWS = 30


@query("user_sequences", with_sql(LISTENS, body="""
    SELECT uid, CAST(0 AS BIGINT) AS segment, array_to_string(list(item_id ORDER BY ts, event_id), ',') AS items,
           array_to_string(list(ts ORDER BY ts, event_id), ',') AS timestamps FROM listens GROUP BY uid"""))
def user_sequences(spark, sf):
    """Whole sequences, gathered from segments of 30 rows."""
    segments = sequences.user_sequences(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id", "ts"], segment_rows=SEGMENT_ROWS)
    s = sequences.whole_sequences(segments, "uid")
    return s.select("uid", F.lit(0).cast("bigint").alias("segment"), F.array_join(F.col("sequence.item_id").cast("array<string>"), ",").alias("items"),
                    F.array_join(F.col("sequence.ts").cast("array<string>"), ",").alias("timestamps"))


@query("sequence_item_frequency", with_sql(PURCHASES, body="SELECT item_id AS item, count(*) AS freq FROM purchases GROUP BY 1"))
def sequence_item_frequency(spark, sf):
    return sequences.item_frequency(purchases(spark, sf), "item_id")


@query("longest_history", with_sql(LISTENS, W_LISTENS.format(src="listens"), body="""
    SELECT uid, event_id, item_id, history_items FROM (
      SELECT *, row_number() OVER (PARTITION BY uid ORDER BY hist_n DESC, event_id) AS rn FROM windows WHERE hist_n > 0) WHERE rn = 1"""))
def longest_history(spark, sf):
    w = sequences.sliding_windows(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"])
    best = sequences.longest_history(w.withColumn("items", sequences.history_of("item_id")), "uid", "items", "event_id",
                                     ["item_id", "items"])
    return best.select("uid", "event_id", "item_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("history_items"))


@query("sequence_length_histogram", with_sql(LISTENS, body="""
    SELECT CASE WHEN n > 70 THEN 35 ELSE CAST(least(floor(n / 2.0), 34) AS BIGINT) END AS bin, count(*) AS n FROM (
      SELECT uid, count(*) AS n FROM listens GROUP BY uid) GROUP BY 1"""))
def sequence_length_histogram(spark, sf):
    counts = listens(spark, sf).groupBy("uid").count()
    return sequences.length_histogram(counts, F.col("count"), bins=35, upper=70.0)


@query("short_sequences_dropped", with_sql(LISTENS, body="""
    SELECT uid, item_id, count(*) AS n FROM listens GROUP BY 1, 2 HAVING count(*) >= 2"""))
def short_sequences_dropped(spark, sf):
    """Sequences by segments of three; a user's segments count together."""
    s = sequences.user_sequences(listens(spark, sf).withColumn("k", F.struct("uid", "item_id")), "k", ["ts", "event_id"], ["ts"], segment_rows=3)
    kept = sequences.drop_short(s, "sequence", "k", 2)
    return kept.groupBy("k").agg(F.sum(F.size("sequence")).alias("n")).select("k.uid", "k.item_id", "n")


@query("repeat_flag", with_sql(LISTENS, body="""
    SELECT event_id, prev = item_id AS is_repeat FROM (
      SELECT event_id, item_id, lag(item_id) OVER (PARTITION BY uid ORDER BY ts, event_id) AS prev FROM listens)
    WHERE prev IS NOT NULL"""))
def repeat_flag(spark, sf):
    w = sequences.sliding_windows(listens(spark, sf), "uid", ["ts", "event_id"], ["item_id"])
    w = w.withColumn("items", sequences.history_of("item_id"))
    return w.select("event_id", sequences.repeats_last("item_id", "items").alias("is_repeat"))


@query("popularity_propensity", with_sql(PURCHASES, body="""
    SELECT item_id, freq, round(pow((freq + 1) / sum(freq + 1) OVER (), 0.05), 9) AS propensity FROM (
      SELECT p_partkey AS item_id, count(purchases.item_id) AS freq FROM part LEFT JOIN purchases ON p_partkey = purchases.item_id GROUP BY 1)"""))
def popularity_propensity(spark, sf):
    p = aggregates.propensity(catalogue(spark, sf), purchases(spark, sf), "item_id")
    return p.withColumn("propensity", F.round("propensity", 9))


# ---- samples and orders (A8, T2-T7, U1, U2) ----
@query("seeded_shuffle_rank", with_sql(LISTENS, body=f"""
    SELECT event_id, row_number() OVER (ORDER BY {hash_sql('event_id')}, event_id) - 1 AS rank FROM listens"""))
def seeded_shuffle_rank(spark, sf):
    return sampling.shuffle_rank(listens(spark, sf).select("event_id"), ["event_id"])


@query("seeded_shuffle", f"SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY {hash_sql('o_orderkey')}, o_orderkey) - 1 AS place FROM orders")
def seeded_shuffle(spark, sf):
    """Rows in their new order, with the place of each."""
    rows = sampling.shuffled(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]).withColumn("at", F.monotonically_increasing_id())
    return ranking.global_rank(materialize(rows, "shuffled"), ["at"], "place").drop("at")


@query("sample_fixed_size", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {hash_sql('o_orderkey', seed=7)}, o_orderkey LIMIT 1000")
def sample_fixed_size(spark, sf):
    return sampling.sample_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 1000, seed=7)


@query("sample_large", with_sql(PURCHASES, body=f"""
    SELECT order_id, line_no, item_id, supp_id FROM purchases
    ORDER BY {hash_sql('order_id', 'line_no', 'item_id', 'supp_id', seed=3)}, order_id, line_no, item_id, supp_id LIMIT 55000"""))
def sample_large(spark, sf):
    return sampling.sample_rows(purchases(spark, sf).select(*P_KEYS), P_KEYS, 55000, seed=3)


@query("drop_first_fifth", with_sql(LISTENS, body=f"""
    SELECT event_id, uid FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql('event_id')}, event_id) - 1 AS r,
      count(*) OVER () AS n FROM listens) WHERE r >= CAST(floor(0.2 * n) AS BIGINT)"""))
def drop_first_fifth(spark, sf):
    return sampling.skip_first_fraction(listens(spark, sf).select("event_id", "uid"), ["event_id"], 0.2)


@query("keep_fraction", with_sql(LISTENS, body=f"""
    SELECT event_id, uid FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql('event_id')}, event_id) - 1 AS r,
      count(*) OVER () AS n FROM listens) WHERE r < CAST(floor(0.5 * n) AS BIGINT)"""))
def keep_fraction(spark, sf):
    return sampling.keep_fraction(listens(spark, sf).select("event_id", "uid"), ["event_id"], 0.5)


@query("first_rows", with_sql(LISTENS, body="SELECT event_id, uid, item_id FROM listens ORDER BY ts, event_id LIMIT 500"))
def first_rows(spark, sf):
    return listens(spark, sf).orderBy("ts", "event_id").limit(500).select("event_id", "uid", "item_id")


@query("mixture_with_upsampling", f"""
    SELECT doc_id, CAST(1 AS BIGINT) AS copy, src FROM (SELECT o_orderkey AS doc_id, 'a' AS src FROM orders
      ORDER BY {hash_sql('o_orderkey')}, o_orderkey LIMIT 3000)
    UNION ALL SELECT doc_id, c AS copy, 'b' AS src FROM documents, (SELECT unnest([1::BIGINT, 2, 3]) AS c)""")
def mixture_with_upsampling(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("a").alias("src"))
    extra = table(spark, sf, "documents").select("doc_id", F.lit("b").alias("src"))
    mixed = sampling.mixture(base.withColumn("key", F.col("doc_id")), ["key"], 3000, extra.withColumn("key", F.col("doc_id")), 3)
    return mixed.select("doc_id", F.col("copy").cast("bigint").alias("copy"), "src")


@query("grouped_repeats", f"""
    SELECT doc_id, pos, {hash_sql('doc_id')} AS shuffle_key FROM documents, (SELECT unnest(range(4)) AS pos)""")
def grouped_repeats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return sampling.grouped_repeats(docs, ["doc_id"], 4).withColumn("pos", F.col("pos").cast("bigint"))


@query("union_of_tasks", """
    SELECT doc_id AS id, text, 'doc' AS task FROM documents UNION ALL SELECT item_id, text, 'bench' FROM benchmark""")
def union_of_tasks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("doc").alias("task"))
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("bench").alias("task"))
    return docs.unionByName(bench)


@query("merge_shards", with_sql(LISTENS, body="""
    SELECT event_id, row_number() OVER (ORDER BY shard, r) - 1 AS merged_row FROM (
      SELECT event_id, r, ((r + 1) * 8 - 1) // n AS shard FROM (
        SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM listens))"""))
def merge_shards(spark, sf):
    sharded = ranking.contiguous_shards(listens(spark, sf).select("event_id"), ["event_id"], 8)
    return ranking.global_rank(sharded, ["shard", "row"], "merged_row").select("event_id", "merged_row")


@query("negative_items", with_sql(PURCHASES, """
    ids AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM purchases)),
    d AS (SELECT p.*, idx, CAST('0x' || substr(md5(order_id || '/' || line_no || '/' || item_id || '/' || supp_id || '|42'), 1, 15) AS BIGINT) % (n - 1) AS draw
          FROM purchases p JOIN ids USING (item_id)),
    g AS (SELECT *, CASE WHEN draw >= idx THEN draw + 1 ELSE draw END AS pick FROM d)""", body="""
    SELECT order_id, line_no, g.item_id, supp_id, ids.item_id AS negative FROM g JOIN ids ON ids.idx = pick"""))
def negative_items(spark, sf):
    p = purchases(spark, sf)
    ids = materialize(ranking.ids_by_key(p, "item_id", "idx"), "ids")
    drawn = p.join(ids, "item_id").select(*P_KEYS, sampling.uniform_negative(F.concat_ws("/", *P_KEYS), F.col("idx"), ids.count()).alias("pick"))
    return drawn.join(ids.select(F.col("item_id").alias("negative"), F.col("idx").alias("pick")), "pick").select(*P_KEYS, "negative")
