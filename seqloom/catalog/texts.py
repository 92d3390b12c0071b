"""Queries for text cleaning, titles, descriptions, prompt pieces and token arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import query, with_sql
from seqloom.catalog.inputs import HIST, ITEM_META, PURCHASES, PURCHASE_ORDER, ROUND_ORDER, item_meta, purchases, table
from seqloom.functions import arrays, prompts, text
from seqloom.operators import aggregates, lookups, sequences

# entities that occur in the given pages; &amp; last, as decoding is a single pass
DECODE = "replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
REVIEW = ("trim(regexp_replace(replace(replace(" + DECODE.format(x="regexp_replace({x}, '<[^>]+>', '', 'g')")
          + ", '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))")
PLAIN = "regexp_replace(regexp_replace(" + DECODE + ", '</?\\w+[^>]*>', '', 'g'), '[\"\\n\\r]', '', 'g')"
DOT = "left({x}, 1) || rtrim(substr({x}, 2), '.') || '.'"
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def joined(col, sep=","):
    return F.array_join(F.col(col).cast("array<string>"), sep)


# ---- cleaning ----
@query("clean_review_pages", f"SELECT page_id, {REVIEW.format(x='html')} AS cleaned FROM pages")
def clean_review_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.clean_review("html").alias("cleaned"))


@query("clean_for_encoder", f"""
    WITH raw AS (SELECT doc_id AS id, 'doc' AS kind, text AS t FROM documents UNION ALL SELECT page_id, 'page', html FROM pages),
    p AS (SELECT id, kind, {PLAIN.format(x=STRIP.format(x='t'))} AS t FROM raw) SELECT id, kind, {DOT.format(x='t')} AS cleaned FROM p""")
def clean_for_encoder(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), F.col("text").alias("t"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("t"))
    return docs.unionByName(pages).select("id", "kind", text.clean_for_encoder("t").alias("cleaned"))


@query("clean_list_for_encoder", f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
    parts AS (SELECT doc_id, p, {STRIP.format(x=PLAIN.format(x='line'))} AS t FROM lines),
    j AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS t FROM parts GROUP BY 1) SELECT doc_id, {DOT.format(x='t')} AS cleaned FROM j""")
def clean_list_for_encoder(spark, sf):
    lists = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return lists.select("doc_id", text.clean_list_for_encoder("lines").alias("cleaned"))


@query("clean_map_for_encoder", f"""
    WITH lists AS (SELECT doc_id, ['language', lang, 'text', text, 'source', source] AS l FROM documents),
    lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM lists),
    parts AS (SELECT doc_id, p, {STRIP.format(x=PLAIN.format(x='line'))} AS t FROM lines),
    j AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS t FROM parts GROUP BY 1) SELECT doc_id, {DOT.format(x='t')} AS cleaned FROM j""")
def clean_map_for_encoder(spark, sf):
    """Keys and values of a map in their order, cleaned and joined like a list."""
    maps = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("language"), "lang", F.lit("text"), "text", F.lit("source"), "source").alias("m"))
    return maps.select("doc_id", text.clean_map_for_encoder("m").alias("cleaned"))


@query("item_texts", with_sql(ITEM_META, "c AS (SELECT page_id, " + PLAIN.format(x=STRIP.format(x="title")) + " AS a, "
    + PLAIN.format(x=STRIP.format(x="html")) + " AS b FROM item_meta)",
    "d AS (SELECT page_id, trim(" + DOT.format(x="a") + ") AS a, trim(" + DOT.format(x="b") + ") AS b FROM c)", body="""
    SELECT page_id, CASE WHEN a = '' AND b = '' THEN 'unknown item' WHEN a = '' THEN b WHEN b = '' THEN a ELSE a || ' ' || b END AS item_text FROM d"""))
def item_texts(spark, sf):
    return item_meta(spark, sf).select("page_id", text.item_text("title", "html").alias("item_text"))


@query("brands_and_categories", """
    SELECT p_partkey, p_brand AS brand, p_type || ',' || p_name AS categories, p_name || ',' || p_type AS flat FROM part""")
def brands_and_categories(spark, sf):
    nested = F.array(F.array("p_type", F.lit("junk</span>")), F.array(F.concat(F.lit(" "), "p_name", F.lit(" "))))
    flat = F.array("p_name", "p_type")
    return table(spark, sf, "part").select(
        "p_partkey", text.clean_brand(F.concat(F.lit(" by\n"), "p_brand")).alias("brand"),
        text.join_categories(text.parse_categories(F.to_json(nested))).alias("categories"),
        text.join_categories(text.parse_categories(F.to_json(flat))).alias("flat"))


@query("month_starts", """
    SELECT o_orderkey, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS start FROM orders""")
def month_starts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.month_start(F.year("o_orderdate"), F.month("o_orderdate")).alias("start"))


@query("review_texts", f"""
    WITH last AS (SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2)
    SELECT conv_id, role, {REVIEW.format(x='text')} AS review, role AS summary FROM last""")
def review_texts(spark, sf):
    c = table(spark, sf, "conversations").withColumn("item", F.col("role")).withColumn("ts", F.lit(0)).withColumn(
        "short", F.concat(F.lit("<i>"), "role", F.lit("</i> ")))
    out = lookups.review_texts(c, "conv_id", "item", "ts", "text", "short", ["turn"])
    return out.select("conv_id", F.col("item").alias("role"), "review", "summary")


# ---- word statistics ----
@query("words_per_user", """
    WITH w AS (SELECT conv_id, len(regexp_split_to_array(trim(text, E' \\n\\t\\r'), '\\s+')) AS n FROM conversations WHERE length(trim(text)) > 0)
    SELECT CAST(sum(n) AS BIGINT) AS words, (SELECT count(DISTINCT conv_id) FROM conversations) AS users,
           round(sum(n) / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS mean_words FROM w""")
def words_per_user(spark, sf):
    out = aggregates.words_per_user(table(spark, sf, "conversations"), "conv_id", "text")
    return out.withColumn("mean_words", F.round("mean_words", 6))


@query("words_per_record", """
    WITH w AS (SELECT len(regexp_split_to_array(trim(text, E' \\n\\t\\r'), '\\s+')) AS n FROM documents WHERE length(trim(text, E' \\n\\t\\r')) > 0)
    SELECT CAST(sum(n) AS BIGINT) AS words, (SELECT count(*) FROM documents) AS records, round(sum(n) / (SELECT count(*) FROM documents), 6) AS mean_words FROM w""")
def words_per_record(spark, sf):
    return aggregates.words_per_record(table(spark, sf, "documents"), "text").withColumn("mean_words", F.round("mean_words", 6))


@query("words_dropped", """
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents),
    k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM w
          WHERE CAST('0x' || substr(md5(doc_id || '|' || i || '|42'), 1, 15) AS BIGINT) / 1152921504606846976.0 > 0.2 GROUP BY 1)
    SELECT doc_id, coalesce(k.text, '') AS text FROM documents LEFT JOIN k USING (doc_id)""")
def words_dropped(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.drop_words("text", "doc_id", 0.2).alias("text"))


# ---- descriptions and prompt pieces ----
DESCRIBED = """described AS (SELECT p_partkey, p_name, p_type, CASE WHEN p_size <= 5 THEN NULL WHEN p_size <= 10 THEN '' WHEN p_size <= 15 THEN '  '
    WHEN p_size <= 25 THEN p_type || ' it' WHEN p_size <= 40 THEN '[''' || p_name || ''', '''', ''' || p_type || ' x'', ''' || p_brand || ''']'
    WHEN p_size <= 45 THEN '[]' ELSE '[broken' || ']' END AS d, p_size, p_brand FROM part)"""


def described(spark, sf):
    size = F.col("p_size")
    listed = F.concat(F.lit("['"), "p_name", F.lit("', '', '"), "p_type", F.lit(" x', '"), "p_brand", F.lit("']"))
    d = (F.when(size <= 5, F.lit(None).cast("string")).when(size <= 10, F.lit("")).when(size <= 15, F.lit("  "))
         .when(size <= 25, F.concat("p_type", F.lit(" it"))).when(size <= 40, listed).when(size <= 45, F.lit("[]")).otherwise(F.lit("[broken]")))
    return table(spark, sf, "part").withColumn("d", d)


@query("longest_description", with_sql(DESCRIBED, body="""
    SELECT p_partkey, CASE WHEN p_size <= 15 OR p_size BETWEEN 41 AND 45 THEN p_name WHEN p_size <= 25 THEN d WHEN p_size > 45 THEN '[broken]'
      WHEN length(p_name) >= length(p_type) + 2 AND length(p_name) >= length(p_brand) THEN p_name
      WHEN length(p_type) + 2 >= length(p_brand) THEN p_type || ' x' ELSE p_brand END AS description FROM described"""))
def longest_description(spark, sf):
    return described(spark, sf).select("p_partkey", prompts.longest_description("d", "p_name").alias("description"))


@query("first_description", with_sql(DESCRIBED, body="""
    SELECT p_partkey, CASE WHEN p_size BETWEEN 26 AND 40 THEN p_name ELSE d END AS description FROM described"""))
def first_description(spark, sf):
    return described(spark, sf).select("p_partkey", prompts.first_description("d").alias("description"))


PW_T = f"""t AS (SELECT purchases.*, p_name AS title FROM purchases JOIN part ON p_partkey = item_id)""", f"""
    w AS (SELECT *, count(*) OVER w AS n, list(title) OVER w AS h, list(item_id) OVER w AS hi FROM t WINDOW w AS (PARTITION BY user_id ORDER BY {ROUND_ORDER} {HIST}))"""


def titled(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    w = sequences.sliding_windows(purchases(spark, sf).join(parts, "item_id"), "user_id", PURCHASE_ORDER, ["title", "item_id"])
    return w.withColumn("h", sequences.history_of("title")).withColumn("hi", sequences.history_of("item_id"))


@query("history_strings", with_sql(PURCHASES, *PW_T, body="""
    SELECT order_id, line_no, item_id, supp_id, array_to_string(h, '::') AS key, array_to_string(h, ', ') AS plain,
      '"' || array_to_string(h, '",' || chr(9) || '"') || '"' AS tabbed, '"' || array_to_string(h, '", "') || '"' AS quoted FROM w WHERE n > 0"""))
def history_strings(spark, sf):
    return titled(spark, sf).select("order_id", "line_no", "item_id", "supp_id", prompts.history_key("h").alias("key"),
                                    prompts.history_text("h").alias("plain"), prompts.quoted_history("h", ",\t").alias("tabbed"),
                                    prompts.quoted_history("h").alias("quoted"))


@query("preference_prompts", with_sql(PURCHASES, *PW_T, body="""
    SELECT order_id, line_no, item_id, supp_id, 'A customer bought these tools items in order:' || chr(10) || array_to_string(h, ', ') || '.' || chr(10)
      || 'Afterwards they chose: ' || title || '. Summarise in the third person what this shows about their preferences, without naming the last item.' AS prompt
    FROM w WHERE n > 0"""))
def preference_prompts(spark, sf):
    filled = prompts.fill(prompts.PREFERENCE_PROMPT, category=F.lit("tools"), titles=prompts.history_text("h"), target=F.col("title"))
    return titled(spark, sf).select("order_id", "line_no", "item_id", "supp_id", filled.alias("prompt"))


@query("intent_prompts", f"""
    SELECT conv_id, turn, 'A customer bought the music item "' || role || '" and wrote:' || chr(10) || '"' || {REVIEW.format(x='text')} || '"' || chr(10)
      || 'Describe, in the first person, what the customer prefers and what the item is like, without its title.' AS prompt FROM conversations""")
def intent_prompts(spark, sf):
    filled = prompts.fill(prompts.INTENT_PROMPT, category=F.lit("music"), title=F.col("role"), review=text.clean_review("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", filled.alias("prompt"))


# ---- answers ----
@query("answers_compared", """
    SELECT doc_id, lang = 'en' AS same, true AS own, 'x ' || lang AS after, text AS cleaned FROM documents""")
def answers_compared(spark, sf):
    wrapped = F.concat(F.lit('"'), "lang", F.lit('"\n'))
    reply = F.concat(F.lit("Response:\nno "), "lang", F.lit(" Response:\n  x "), "lang", F.lit(" \n"))
    return table(spark, sf, "documents").select(
        "doc_id", text.same_answer(wrapped, F.lit("en ")).alias("same"), text.same_answer(wrapped, "lang", blanks=False).alias("own"),
        text.after_response(reply).alias("after"), text.drop_end_markers(F.concat("text", F.lit("<|im_end|>"))).alias("cleaned"))


# ---- token arrays ----
@query("padded_histories", with_sql(PURCHASES, *PW_T, body="""
    SELECT order_id, line_no, item_id, supp_id, array_to_string(list_slice(hi, greatest(len(hi) - 5, 1), len(hi)) || list_resize([]::BIGINT[], greatest(6 - len(hi), 0), -1), ',') AS padded
    FROM w WHERE n > 0"""))
def padded_histories(spark, sf):
    return titled(spark, sf).withColumn("p", arrays.pad_right("hi", 6, F.lit(-1).cast("bigint"))).select(
        "order_id", "line_no", "item_id", "supp_id", joined("p").alias("padded"))


def token_arrays(spark, sf):
    """Histories as token arrays, with the user as batch."""
    return titled(spark, sf).select("order_id", "line_no", "item_id", "supp_id", "user_id", F.col("hi").alias("tokens"))


TOKENS = (*PW_T, "b0 AS (SELECT order_id, line_no, item_id, supp_id, user_id, hi AS tokens FROM w WHERE n > 0)")
ROW = ["order_id", "line_no", "item_id", "supp_id"]


@query("batch_left_padding", with_sql(PURCHASES, *TOKENS, "b AS (SELECT *, max(len(tokens)) OVER (PARTITION BY user_id) - len(tokens) AS gap FROM b0)", body="""
    SELECT order_id, line_no, item_id, supp_id, array_to_string(list_resize([]::BIGINT[], gap, 0) || tokens, ',') AS tokens,
      array_to_string(list_resize([]::BIGINT[], gap, 0) || list_resize([]::BIGINT[], len(tokens), 1), ',') AS mask FROM b"""))
def batch_left_padding(spark, sf):
    out = arrays.pad_left_in_batch(token_arrays(spark, sf), "user_id", "tokens", F.lit(0).cast("bigint"))
    return out.select(*ROW, joined("tokens").alias("tokens"), joined("mask").alias("mask"))


@query("training_token_arrays", with_sql(PURCHASES, *TOKENS, "b AS (SELECT *, tokens AS p, [user_id, 2] AS a FROM b0)",
    "c AS (SELECT *, p || a AS t, list_resize([]::BIGINT[], len(p), -100) || a AS l FROM b)", body="""
    SELECT order_id, line_no, item_id, supp_id, array_to_string(list_slice(t, greatest(len(t) - 4, 1), len(t)), ',') AS tokens,
      array_to_string(list_slice(l, greatest(len(l) - 4, 1), len(l)), ',') AS labels, least(len(t), 5) AS n_mask FROM c"""))
def training_token_arrays(spark, sf):
    b = token_arrays(spark, sf).withColumn("answer", F.array("user_id", F.lit(2).cast("bigint")))
    tokens, mask, labels = arrays.training_tokens("tokens", "answer", 5)
    out = b.select(*ROW, tokens.alias("t"), labels.alias("l"), mask.alias("m"))
    return out.select(*ROW, joined("t").alias("tokens"), joined("l").alias("labels"), F.size("m").cast("bigint").alias("n_mask"))


@query("masked_after_end", with_sql(PURCHASES, *TOKENS, "b AS (SELECT *, list_position(list_transform(tokens, lambda x: x % 7), 0) AS e FROM b0)", body="""
    SELECT order_id, line_no, item_id, supp_id, array_to_string(list_slice(list_transform(tokens, lambda x: x % 7), 1, CASE WHEN e > 0 THEN e ELSE len(tokens) END), ',') AS kept,
      array_to_string(list_resize([]::BIGINT[], CASE WHEN e > 0 THEN e ELSE len(tokens) END, 1)
        || list_resize([]::BIGINT[], len(tokens) - CASE WHEN e > 0 THEN e ELSE len(tokens) END, 0), ',') AS mask FROM b"""))
def masked_after_end(spark, sf):
    b = token_arrays(spark, sf).withColumn("tokens", F.transform("tokens", lambda x: x % 7))
    kept, mask = arrays.until_end_token("tokens", F.lit(0).cast("bigint"))
    out = b.select(*ROW, kept.alias("k"), mask.alias("m"))
    return out.select(*ROW, joined("k").alias("kept"), joined("m").alias("mask"))
