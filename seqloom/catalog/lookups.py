"""Queries for filters, projections and look-up joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import query, with_sql
from seqloom.catalog.inputs import (
    CATALOGUE, HIST, ITEM_META, LISTENS, PURCHASES, PURCHASE_ORDER, ROUND_ORDER, catalogue, item_meta, listens, purchases, table,
)
from seqloom.functions import text
from seqloom.operators import aggregates, lookups, sequences

KEYS = ["order_id", "line_no", "item_id", "supp_id"]
ROW = [*KEYS, "rating"]
PW = f"""pw AS MATERIALIZED (SELECT *, count(*) OVER w AS hist_n, list(item_id) OVER w AS hi
   FROM purchases WINDOW w AS (PARTITION BY user_id ORDER BY {ROUND_ORDER} {HIST}))"""


def compact_samples(spark, sf):
    """Windows over purchases as (row key, user, history ids, target id), 32 rows of a user to a `block`."""
    w = sequences.sliding_windows(purchases(spark, sf), "user_id", PURCHASE_ORDER, ["item_id"], position="place")
    return w.withColumn("history", sequences.history_of("item_id")).withColumn("block", F.expr("place div 32"))


def joined(col, sep=","):
    return F.array_join(F.col(col).cast("array<string>"), sep)


# ---- filters ----
@query("time_range", with_sql(PURCHASES, body="""
    SELECT order_id, line_no, item_id, supp_id, ts FROM purchases WHERE ts BETWEEN epoch(TIMESTAMP '1996-10-01') AND epoch(TIMESTAMP '1998-11-01')"""))
def time_range(spark, sf):
    start, end = text.month_start(F.lit(1996), F.lit(10)), text.month_start(F.lit(1998), F.lit(11))
    return purchases(spark, sf).filter(F.col("ts").between(start, end)).select(*KEYS, "ts")


@query("titles_lenient", with_sql(ITEM_META, body="""
    SELECT page_id, trim(title) AS title FROM item_meta WHERE length(trim(title)) > 0"""))
def titles_lenient(spark, sf):
    return item_meta(spark, sf).filter(text.title_present("title")).select("page_id", text.strip(F.col("title")).alias("title"))


@query("titles_strict", with_sql(ITEM_META, """cleaned AS (
    SELECT page_id, title AS raw, trim(trim(replace(replace(title, '&quot;', '"'), '&amp;', '&'), ' '), '"') AS title FROM item_meta)""", body="""
    SELECT page_id, title FROM cleaned WHERE raw NOT LIKE '%<span id%' AND length(title) > 1
      AND len(string_split(title, ' ')) <= 20"""))
def titles_strict(spark, sf):
    return item_meta(spark, sf).filter(text.title_strict("title")).select("page_id", text.clean_title("title").alias("title"))


@query("behaviour_filter", with_sql(LISTENS, body="""
    SELECT event_id, uid, item_id, value FROM listens WHERE value >= 50 AND ts < epoch_us(TIMESTAMP '2024-01-20')"""))
def behaviour_filter(spark, sf):
    cap = F.datediff(F.lit("2024-01-20").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400000000
    return listens(spark, sf).filter((F.col("ts") < cap) & (F.col("value") >= 50)).select("event_id", "uid", "item_id", "value")


@query("membership_filter", with_sql(PURCHASES, body="""
    SELECT order_id, line_no, item_id, supp_id FROM purchases WHERE item_id IN (SELECT vec_id FROM embeddings)"""))
def membership_filter(spark, sf):
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"))
    return lookups.only_known(purchases(spark, sf), ids, "item_id").select(*KEYS)


@query("train_split_only", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def train_split_only(spark, sf):
    return table(spark, sf, "labels").filter("quality = 1").select("doc_id", "toxic")


@query("complete_preferences", """
    SELECT c.conv_id, c.turn, c.text FROM conversations c WHERE role = 'user' AND length(trim(text)) > 0""")
def complete_preferences(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.filter(text.title_present("text")).select("conv_id", "turn", "text")


@query("reviews_with_valid_title", with_sql(LISTENS, ITEM_META, body="""
    SELECT event_id, uid, item_id FROM listens WHERE item_id IN (SELECT page_id FROM item_meta WHERE length(trim(title)) > 0)"""))
def reviews_with_valid_title(spark, sf):
    titled = item_meta(spark, sf).filter(text.title_present("title")).select(F.col("page_id").alias("item_id"))
    return lookups.only_known(listens(spark, sf), titled, "item_id").select("event_id", "uid", "item_id")


@query("removed_items", with_sql(PURCHASES, body="""
    SELECT order_id, line_no, item_id, supp_id FROM purchases
    WHERE item_id NOT IN (SELECT item_id FROM purchases GROUP BY 1 HAVING count(*) < 25)"""))
def removed_items(spark, sf):
    p = purchases(spark, sf)
    rare = p.groupBy("item_id").count().filter("count < 25")
    return lookups.without(p, rare, "item_id").select(*KEYS)


@query("pruned_interactions", with_sql(PURCHASES, body="""
    SELECT order_id, line_no, item_id, supp_id FROM purchases
    WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND item_id IN (SELECT p_partkey FROM part WHERE p_retailprice > 950)"""))
def pruned_interactions(spark, sf):
    users = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    items = table(spark, sf, "part").filter("p_retailprice > 950").select(F.col("p_partkey").alias("item_id"))
    return lookups.prune_to(purchases(spark, sf), users, items, "user_id", "item_id").select(*KEYS)


@query("user_and_item_sets", with_sql(PURCHASES, body="""
    SELECT 'user' AS side, user_id AS id FROM purchases GROUP BY 2 UNION ALL SELECT 'item', item_id FROM purchases GROUP BY 2"""))
def user_and_item_sets(spark, sf):
    p = purchases(spark, sf)
    users = p.select("user_id").distinct().select(F.lit("user").alias("side"), F.col("user_id").alias("id"))
    return users.unionByName(p.select("item_id").distinct().select(F.lit("item").alias("side"), F.col("item_id").alias("id")))


# ---- projections ----
@query("listen_to_review", with_sql(LISTENS, body="""
    SELECT event_id, 'u_' || uid AS "reviewerID", 'i_' || item_id AS asin, CAST(5 AS DOUBLE) AS overall,
           ts AS "unixReviewTime", '01 1, 2017' AS "reviewTime", '' AS summary, '' AS "reviewText", item_id AS orig_item_id,
           CAST(1 AS BIGINT) AS is_organic, value AS played_ratio_pct, event_type FROM listens"""))
def listen_to_review(spark, sf):
    from seqloom.sources.readers import listens_as_reviews

    rows = listens(spark, sf).withColumnRenamed("ts", "timestamp").withColumn("played_ratio_pct", F.col("value"))
    out = listens_as_reviews(rows.withColumn("track_length_seconds", F.lit(None).cast("int")), keep=["event_id"])
    return out.drop("track_length_seconds").withColumn("is_organic", F.col("is_organic").cast("bigint"))


@query("track_titles", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'Track ' || event_id ELSE 'Track ' || event_id || ' - ' || CAST(floor(floor(value * 10) / 60) AS BIGINT)
      || ' min ' || CAST(floor(value * 10) AS BIGINT) % 60 || ' sec' END AS title FROM events""")
def track_titles(spark, sf):
    seconds = F.when(F.col("event_type") != "error", F.floor(F.col("value") * 10))
    return table(spark, sf, "events").select("event_id", text.track_title(F.col("event_id"), seconds).alias("title"))


@query("bare_metadata", with_sql(LISTENS, body="""
    SELECT 'i_' || item_id AS asin, 'Track i_' || item_id AS title, '' AS description, '' AS brand, '' AS categories
    FROM listens GROUP BY item_id"""))
def bare_metadata(spark, sf):
    from seqloom.sources.readers import bare_item_meta

    asin = F.concat(F.lit("i_"), F.col("item_id").cast("string"))
    rows = listens(spark, sf).select(asin.alias("asin"), F.lit(None).cast("int").alias("track_length_seconds"), "ts", "event_id")
    return bare_item_meta(rows, ["ts", "event_id"]).withColumn("categories", F.array_join("categories", ","))


@query("category_phrases", """
    SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'industrial and scientific items' WHEN 'FURNITURE' THEN 'office products' ELSE c_mktsegment END AS phrase FROM customer""")
def category_phrases(spark, sf):
    names = {"MACHINERY": text.CATEGORY_PHRASES["Industrial_and_Scientific"], "FURNITURE": text.CATEGORY_PHRASES["Office_Products"]}
    return table(spark, sf, "customer").select("c_custkey", text.lookup_name(F.col("c_mktsegment"), names).alias("phrase"))


SID_SAMPLES_SQL = with_sql(PURCHASES, CATALOGUE, "known AS (SELECT * FROM catalogue WHERE c3 <= 45)",
    "titles AS (SELECT item_id, title FROM catalogue WHERE c3 >= 3)", PW,
    """flat AS (SELECT order_id, line_no, item_id, supp_id, rating, unnest(hi) AS h, generate_subscripts(hi, 1) AS p FROM pw WHERE hist_n > 0)""",
    """gathered AS (SELECT flat.order_id, flat.line_no, flat.item_id, flat.supp_id, flat.rating,
         string_agg(titles.title, '|' ORDER BY p) AS ht, string_agg(known.sid, ' ' ORDER BY p) AS hs
       FROM flat LEFT JOIN titles ON h = titles.item_id LEFT JOIN known ON h = known.item_id GROUP BY ALL)""", body="""
    SELECT order_id, line_no, supp_id, rating, 'A' || user_id AS user_id, item_id, array_to_string(hi, ',') AS history_item_id,
           coalesce(ht, '') AS history_item_title, coalesce(hs, '') AS history_item_sid, known.sid AS item_sid,
           coalesce(titles.title, 'Item_' || item_id) AS item_title
    FROM pw JOIN gathered USING (order_id, line_no, item_id, supp_id, rating) JOIN known USING (item_id) LEFT JOIN titles USING (item_id)""")


@query("sid_samples", SID_SAMPLES_SQL)
def sid_samples(spark, sf):
    cat = catalogue(spark, sf)
    sids = cat.filter(F.get("codes", F.lit(2)) <= 45).select("item_id", "sid")
    titles = cat.filter(F.get("codes", F.lit(2)) >= 3).select("item_id", "title")
    samples = compact_samples(spark, sf).select("user_id", "block", *ROW, "history")
    out = lookups.sid_samples(samples, ROW, "history", "item_id", "user_id", titles, sids, near=["user_id", "block"])
    return out.withColumns({
        "history_item_id": joined("history_item_id"), "history_item_title": joined("history_item_title", "|"),
        "history_item_sid": joined("history_item_sid", " ")})


@query("history_sids_keep_raw", with_sql(PURCHASES, CATALOGUE, "known AS (SELECT * FROM catalogue WHERE c3 <= 45)", PW,
    """flat AS (SELECT order_id, line_no, item_id, supp_id, rating, unnest(hi) AS h, generate_subscripts(hi, 1) AS p FROM pw WHERE hist_n > 0)""", body="""
    SELECT flat.order_id, flat.line_no, flat.item_id, flat.supp_id, flat.rating, string_agg(coalesce(known.sid, CAST(h AS VARCHAR)), ' ' ORDER BY p) AS history_sid
    FROM flat LEFT JOIN known ON h = known.item_id GROUP BY ALL"""))
def history_sids_keep_raw(spark, sf):
    sids = catalogue(spark, sf).filter(F.get("codes", F.lit(2)) <= 45).select(F.col("item_id").alias("k"), "sid")
    samples = compact_samples(spark, sf).select("user_id", "block", *ROW, "history")
    out = lookups.map_elements(samples, ROW, "history", sids, "k", {"sids": F.coalesce("sid", F.col("__id").cast("string"))},
                               keep_unmapped=True, near=["user_id", "block"])
    return out.select(*ROW, joined("sids", " ").alias("history_sid"))


@query("rekeyed_events", with_sql(PURCHASES,
    "u AS (SELECT c_custkey AS user_id, row_number() OVER (ORDER BY c_custkey) - 1 AS user_idx FROM customer WHERE c_nationkey < 20)",
    "i AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS item_idx FROM part WHERE p_size < 40)", body="""
    SELECT order_id, line_no, supp_id, item_id, user_idx, item_idx FROM purchases JOIN u USING (user_id) JOIN i USING (item_id)"""))
def rekeyed_events(spark, sf):
    from seqloom.operators.ranking import ids_by_key

    users = ids_by_key(table(spark, sf, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("user_id")), "user_id", "user_idx")
    items = ids_by_key(table(spark, sf, "part").filter("p_size < 40").select(F.col("p_partkey").alias("item_id")), "item_id", "item_idx")
    return lookups.rekey_events(purchases(spark, sf), users, items, "user_id", "item_id").select(*KEYS, "user_idx", "item_idx")


@query("target_text_fallback", with_sql(PURCHASES, CATALOGUE, "known AS (SELECT * FROM catalogue WHERE c3 <= 45)", body="""
    SELECT order_id, line_no, item_id, supp_id, coalesce(title, 'Unknown item ' || item_id) AS target_title
    FROM purchases LEFT JOIN known USING (item_id)"""))
def target_text_fallback(spark, sf):
    known = catalogue(spark, sf).filter(F.get("codes", F.lit(2)) <= 45).select("item_id", "title")
    unknown = F.concat(F.lit("Unknown item "), F.col("item_id").cast("string"))
    return purchases(spark, sf).join(known, "item_id", "left").select(*KEYS, F.coalesce("title", unknown).alias("target_title"))


@query("item_features_last_wins", """
    WITH latest AS (SELECT p_name AS asin, max(p_partkey) AS k FROM part GROUP BY 1)
    SELECT k AS item_id, p_name AS title, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_type ELSE p_name || ' in ' || p_type END AS description, p_brand AS brand, p_type || ',' || p_brand AS categories
    FROM latest JOIN part ON p_partkey = k""")
def item_features_last_wins(spark, sf):
    part = table(spark, sf, "part")
    meta = part.select(
        F.col("p_name").alias("asin"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 4 == 0, "[]").when(F.col("p_size") % 4 == 1, F.concat(F.lit('["'), "p_type", F.lit('", "more"]')))
        .otherwise(F.concat("p_name", F.lit(" <b>in</b>  "), "p_type")).alias("description"),
        F.concat(F.lit("by\n"), "p_brand").alias("brand"),
        F.concat(F.lit('[["'), "p_type", F.lit('", "x</span>"], [" '), "p_brand", F.lit('"]]')).alias("categories"), "p_partkey")
    items = part.groupBy(F.col("p_name").alias("asin")).agg(F.max("p_partkey").alias("item_id"))
    return lookups.item_features(items, meta, ["p_partkey"])


@query("aligned_embeddings", """
    SELECT idx, found, round(CASE WHEN found THEN s ELSE 0 END, 5) AS total FROM (
      SELECT p_partkey AS idx, vec_id IS NOT NULL AS found, coalesce(list_sum(CAST(embedding AS DOUBLE[])), 0) AS s
      FROM part LEFT JOIN embeddings ON p_partkey = vec_id)""")
def aligned_embeddings(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_partkey").alias("idx"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    out = lookups.align_embeddings(items, vectors, "item_id", "idx", 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("idx", "found", F.round(total, 5).alias("total"))


@query("aligned_maps", """
    SELECT coalesce(p_partkey, s_suppkey) AS item_id, p_brand AS album, s_name AS artist
    FROM (SELECT * FROM part WHERE p_size > 10) FULL JOIN supplier ON p_partkey = s_suppkey""")
def aligned_maps(spark, sf):
    album = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("album"))
    artist = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("artist"))
    return lookups.align_maps(album, artist, "item_id")


@query("rekeyed_index", with_sql(CATALOGUE, """
    old AS (SELECT item_id AS orig, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM catalogue)""", """
    new AS (SELECT item_id AS orig, row_number() OVER (ORDER BY title, item_id) - 1 AS idx FROM catalogue WHERE c3 > 5)""", """
    ix AS (SELECT idx AS item_id, sid FROM catalogue JOIN old ON catalogue.item_id = orig)""", body="""
    SELECT new.idx AS item_id, sid FROM ix JOIN old ON ix.item_id = old.idx JOIN new USING (orig)"""))
def rekeyed_index(spark, sf):
    from seqloom.operators.ranking import dense_ids

    cat = catalogue(spark, sf)
    old = dense_ids(cat.select(F.col("item_id").alias("orig")), ["orig"])
    newer = cat.filter(F.get("codes", F.lit(2)) > 5).select(F.col("item_id").alias("orig"), "title")
    new = dense_ids(newer, ["title", "orig"]).drop("title")
    index = cat.join(old, cat.item_id == old.orig).select(F.col("idx").alias("item_id"), "sid")
    return lookups.rekey_index(index, old, new)


@query("invalid_predictions", with_sql(LISTENS, body="""
    SELECT event_id, item_id FROM listens WHERE item_id NOT IN (SELECT item_id FROM benchmark)"""))
def invalid_predictions(spark, sf):
    return lookups.invalid_predictions(listens(spark, sf).select("event_id", "item_id"), table(spark, sf, "benchmark"), "item_id", "item_id")


@query("prediction_catalogue_ids", with_sql(LISTENS, CATALOGUE, """
    ids AS (SELECT sid, min(r) AS catalogue_id FROM (SELECT sid, row_number() OVER (ORDER BY item_id) - 1 AS r FROM catalogue WHERE c3 <= 40) GROUP BY 1)""", body="""
    SELECT event_id, catalogue_id, catalogue_id IS NOT NULL AS valid FROM listens JOIN catalogue USING (item_id) LEFT JOIN ids USING (sid)"""))
def prediction_catalogue_ids(spark, sf):
    from seqloom.operators.ranking import dense_ids

    cat = catalogue(spark, sf)
    known = dense_ids(cat.filter(F.get("codes", F.lit(2)) <= 40).select("item_id", "sid"), ["item_id"], "catalogue_id")
    answers = listens(spark, sf).join(cat.select("item_id", "sid"), "item_id").select("event_id", F.col("sid").alias("answer"))
    return lookups.catalogue_ids(answers, known, "answer", "sid", "catalogue_id").drop("answer")


@query("prompt_history_target", with_sql(LISTENS, """
    h AS (SELECT event_id, 'user ' || uid AS prompt, event_type || ' ' || (uid % 40) AS history, item_id FROM listens)""", body="""
    SELECT prompt, history, target FROM (SELECT prompt, arg_max(history, event_id) AS history FROM h GROUP BY 1)
    JOIN (SELECT history, arg_max(item_id, event_id) AS target FROM h GROUP BY 1) USING (history)"""))
def prompt_history_target(spark, sf):
    rows = listens(spark, sf).select(
        "event_id", F.concat(F.lit("user "), F.col("uid").cast("string")).alias("prompt"),
        F.concat("event_type", F.lit(" "), (F.col("uid") % 40).cast("string")).alias("history"), F.col("item_id").alias("target"))
    return lookups.target_by_history(rows, "prompt", "history", "target", ["event_id"]).select("prompt", "history", "target")


@query("last_wins_title_to_sid", with_sql(CATALOGUE, body="SELECT title, arg_max(sid, item_id) AS sid FROM catalogue GROUP BY 1"))
def last_wins_title_to_sid(spark, sf):
    return aggregates.last_wins(catalogue(spark, sf), "title", ["item_id"], ["sid"])


@query("last_wins_sid_to_title", with_sql(CATALOGUE, body="SELECT sid, arg_max(title, item_id) AS title FROM catalogue GROUP BY 1"))
def last_wins_sid_to_title(spark, sf):
    return aggregates.last_wins(catalogue(spark, sf), "sid", ["item_id"], ["title"])


@query("catalogue_info", with_sql(CATALOGUE, body="""
    SELECT row_number() OVER (ORDER BY item_id) - 1 AS catalogue_id, sid || chr(9) || CASE WHEN c3 >= 3 THEN title ELSE 'Item_' || item_id END || chr(9) || item_id AS line
    FROM catalogue"""))
def catalogue_info(spark, sf):
    from seqloom.operators.ranking import dense_ids
    from seqloom.sources.writers import catalogue_rows

    cat = catalogue(spark, sf)
    titles = cat.select("item_id", F.when(F.get("codes", F.lit(2)) >= 3, F.col("title")).alias("title"))
    rows = dense_ids(catalogue_rows(titles, cat.select("item_id", "sid")), ["item_id"], "catalogue_id")
    return rows.select("catalogue_id", F.concat_ws("\t", "sid", "title", F.col("item_id").cast("string")).alias("line"))
