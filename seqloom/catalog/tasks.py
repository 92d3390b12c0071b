"""Queries for the prompt/completion tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from seqloom.catalog.base import query, with_sql
from seqloom.catalog.inputs import CATALOGUE, HIST, LISTENS, catalogue, listens, table
from seqloom.catalog.interactions import hash_sql
from seqloom.functions import prompts, sids
from seqloom.operators import lookups, sequences
from seqloom.plans import tasks
from seqloom.plans.dataset import titled_windows
from seqloom.session import materialize

KEY = ["event_id"]
CATEGORY = "tracks"


def q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def fill_sql(template: str, **slots: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(slots[p] if i % 2 else q(p) for i, p in enumerate(parts) if i % 2 or p)


def frame_sql(question: str, instruction: str | None = None, **slots: str) -> str:
    body = fill_sql(prompts.FRAME, question="(" + fill_sql(question, **slots) + ")")
    return body if instruction is None else fill_sql(prompts.PREAMBLE, instruction=f"({instruction})") + " || " + body


def task_sql(name: str, prompt: str, completion: str | None, history: str, target: str, source: str, key: str = "event_id, ") -> str:
    return (f"SELECT {key}'{name}' AS task, {prompt} AS prompt, {completion or 'CAST(NULL AS VARCHAR)'} AS completion, "
            f"{history} AS history_str, {target} AS target FROM {source}")


SAMPLES = f"""samples AS MATERIALIZED (SELECT * FROM (SELECT t.*, count(*) OVER w AS n, list(title) OVER w AS ht, list(sid) OVER w AS hs, list(item_id) OVER w AS hi
  FROM (SELECT listens.*, title, sid FROM listens JOIN catalogue USING (item_id)) t WINDOW w AS (PARTITION BY uid ORDER BY ts, event_id {HIST})) WHERE n > 0)"""
BASE = (LISTENS, CATALOGUE, SAMPLES)
NL = "|| chr(10)"
TABBED = "'\"' || array_to_string(ht, '\",' || chr(9) || '\"') || '\"'"
QUOTED = "'\"' || array_to_string(ht, '\", \"') || '\"'"
VARIANT = "(list_value(" + ", ".join(q(v.replace("{category}", CATEGORY)) for v in prompts.NEXT_ITEM_INSTRUCTIONS) + \
    f"))[{hash_sql('event_id')} % {len(prompts.NEXT_ITEM_INSTRUCTIONS)} + 1]"


def samples(spark, sf):
    items = catalogue(spark, sf).select("item_id", "title", "sid")
    w = titled_windows(listens(spark, sf), items, "uid", ["ts", "event_id"])
    return w.select("event_id", "uid", "item_id", "title", "sid", "ts", "value", *[
        sequences.history_of(f).alias(n) for f, n in (("title", "history_title"), ("sid", "history_sid"), ("item_id", "history_item"))])


def items(spark, sf):
    """Catalogue with a description and the three-level SID that serves as key."""
    size = F.get("codes", F.lit(2))
    d = F.when(size <= 5, F.lit("")).when(size <= 25, F.concat("category", F.lit(" by "), "brand")).otherwise(
        F.concat(F.lit("['"), "title", F.lit("', '"), "category", F.lit(" from "), "brand", F.lit("']")))
    return catalogue(spark, sf).withColumn("sid3", sids.sid_prefix("tokens")).withColumn("description", d)


ITEMS = """items AS MATERIALIZED (SELECT *, CASE WHEN c3 <= 5 THEN '' WHEN c3 <= 25 THEN category || ' by ' || brand ELSE '' END AS plain,
    c3 > 25 AS listed, category || ' from ' || brand AS second FROM catalogue)"""
TITLE_LINE, SID_LINE = f"'\"' || title || '\"' {NL}", f"sid {NL}"


def title_next_sql(name, completion):
    return task_sql(name, frame_sql(tasks.TITLES_QUESTION, VARIANT, category=q(CATEGORY), history=TABBED), completion,
                    "array_to_string(ht, '::')", TITLE_LINE, "samples")


@query("task_title_next", with_sql(*BASE, body=title_next_sql("title_next", TITLE_LINE)))
def task_title_next(spark, sf):
    return tasks.title_history_to_title(samples(spark, sf), KEY, CATEGORY)


@query("task_title_eval", with_sql(*BASE, body=title_next_sql("title_eval", None)))
def task_title_eval(spark, sf):
    return tasks.title_history_to_title(samples(spark, sf), KEY, CATEGORY, evaluate=True)


@query("task_title_maps", with_sql(*BASE, "t AS (" + title_next_sql("title_next", TITLE_LINE) + ")", body="""
    SELECT prompt, h.history_str, g.target FROM (SELECT prompt, arg_max(history_str, event_id) AS history_str FROM t GROUP BY 1) h
    JOIN (SELECT history_str, arg_max(target, event_id) AS target FROM t GROUP BY 1) g USING (history_str)"""))
def task_title_maps(spark, sf):
    rows = tasks.title_history_to_title(samples(spark, sf), KEY, CATEGORY)
    return lookups.target_by_history(rows, "prompt", "history_str", "target", KEY).select("prompt", "history_str", "target")


HS = "array_to_string(hs, ', ')"


def sid_next_sql(name, question, completion=SID_LINE, instruction=None):
    return task_sql(name, frame_sql(question, instruction, history=HS), completion, "array_to_string(hs, '::')", SID_LINE, "samples")


@query("task_sid_next", with_sql(*BASE, body=sid_next_sql("sid_next", tasks.SIDS_QUESTION)))
def task_sid_next(spark, sf):
    return tasks.sid_history_to_sid(samples(spark, sf), KEY)


@query("task_sid_next_instructed", with_sql(*BASE, body=sid_next_sql("sid_next_instructed", tasks.SIDS_QUESTION, instruction=q(tasks.SID_INSTRUCTION))))
def task_sid_next_instructed(spark, sf):
    return tasks.sid_history_to_sid(samples(spark, sf), KEY, tasks.SID_INSTRUCTION)


@query("task_sid_eval", with_sql(*BASE, body=sid_next_sql("sid_eval", tasks.SIDS_EVAL_QUESTION, None, q(tasks.SID_INSTRUCTION))))
def task_sid_eval(spark, sf):
    return tasks.sid_history_to_sid(samples(spark, sf), KEY, tasks.SID_INSTRUCTION, evaluate=True)


def pair_sql(name, question, source, target, rows="catalogue"):
    latest = f"(SELECT {source} AS s, arg_max({target}, item_id) AS t FROM {rows} GROUP BY 1)"
    return task_sql(name, frame_sql(question, input="s"), f"t {NL}", "s", f"t {NL}", latest, key="")


@query("task_item_identification", with_sql(CATALOGUE, body=pair_sql("sid_to_title", tasks.SID_TO_TITLE, "sid", "title")
       + "\nUNION ALL " + pair_sql("title_to_sid", tasks.TITLE_TO_SID, "title", "sid")))
def task_item_identification(spark, sf):
    return tasks.item_identification(items(spark, sf), ["item_id"])


@query("task_item_text_to_sid", with_sql(CATALOGUE, ITEMS, "d AS (SELECT item_id, sid, CASE WHEN listed THEN title ELSE plain END AS d FROM items)",
       body=pair_sql("title_to_sid", tasks.TITLE_TO_SID, "title", "sid")
       + "\nUNION ALL " + pair_sql("description_to_sid", tasks.DESCRIPTION_TO_SID, "d", "sid", "d")))
def task_item_text_to_sid(spark, sf):
    return tasks.item_text_to_sid(items(spark, sf), ["item_id"])


@query("task_sid_to_title", with_sql(CATALOGUE, body=pair_sql("sid_to_title", tasks.SID_TO_TITLE, "sid", "title")))
def task_sid_to_title(spark, sf):
    return tasks.sid_to_title(items(spark, sf), ["item_id"])


def titles_sid_sql(source):
    return task_sql("titles_to_sid", frame_sql(tasks.TITLES_SID_QUESTION, history=QUOTED), SID_LINE, "array_to_string(ht, '::')", SID_LINE, source)


@query("task_titles_to_sid", with_sql(*BASE, "f AS (SELECT * FROM samples WHERE sid <> hs[-1])", body=titles_sid_sql("f")))
def task_titles_to_sid(spark, sf):
    return tasks.title_history_to_sid(samples(spark, sf), KEY)


@query("task_titles_to_sid_sampled", with_sql(*BASE, f"""f AS (SELECT * FROM samples WHERE sid <> hs[-1]
    ORDER BY {hash_sql('event_id')}, event_id LIMIT 2000)""", body=titles_sid_sql("f")))
def task_titles_to_sid_sampled(spark, sf):
    return tasks.title_history_to_sid(samples(spark, sf), KEY, sample=2000)


@query("task_sids_to_title", with_sql(*BASE, "f AS (SELECT samples.*, k.title AS found FROM samples LEFT JOIN (SELECT item_id, title FROM catalogue WHERE c3 <= 40) k USING (item_id) WHERE sid <> hs[-1])",
       body=task_sql("sids_to_title", frame_sql(tasks.SIDS_TITLE_QUESTION, history=HS), f"coalesce(found, 'Unknown item ' || item_id) {NL}",
                     "array_to_string(hs, '::')", f"coalesce(found, 'Unknown item ' || item_id) {NL}", "f")))
def task_sids_to_title(spark, sf):
    titles = catalogue(spark, sf).filter(F.get("codes", F.lit(2)) <= 40).select("item_id", F.col("title").alias("found_title"))
    return tasks.sid_history_to_title(samples(spark, sf), KEY, titles, drop_repeats=True)


SHOWN = """known AS (SELECT sid, arg_max(title, item_id) AS kt, arg_max(CASE WHEN listed THEN CASE WHEN length(title) >= length(second) THEN title ELSE second END
    WHEN plain = '' THEN title ELSE plain END, item_id) AS kd FROM items WHERE c3 <= 40 GROUP BY 1)""", """
    f AS (SELECT samples.*, kt, kd FROM samples LEFT JOIN known USING (sid))"""


def known_items(spark, sf):
    return items(spark, sf).filter(F.get("codes", F.lit(2)) <= 40).select("item_id", "sid", "title", "description")


def item_text_sql(name, question, answer):
    return task_sql(name, frame_sql(question, q(tasks.SID_INSTRUCTION), history=HS), f"{answer} {NL}", HS, f"{answer} {NL}", "f")


@query("task_sids_to_item_title", with_sql(*BASE, ITEMS, *SHOWN, body=item_text_sql("sids_to_item_title", tasks.SIDS_TITLE_QUESTION, "coalesce(kt, sid)")))
def task_sids_to_item_title(spark, sf):
    return tasks.sid_history_to_item_text(samples(spark, sf), KEY, known_items(spark, sf), ["item_id"])


@query("task_sids_to_description", with_sql(*BASE, ITEMS, *SHOWN, body=item_text_sql(
    "sids_to_description", tasks.SIDS_DESCRIPTION_QUESTION, "coalesce(kd, 'An item with semantic ID ' || sid)")))
def task_sids_to_description(spark, sf):
    return tasks.sid_history_to_item_text(samples(spark, sf), KEY, known_items(spark, sf), ["item_id"], description=True)


def indexed_sid_sql(source):
    return task_sql("titles_to_indexed_sid", frame_sql(tasks.TITLES_SID_QUESTION, q(tasks.SID_INSTRUCTION), history=QUOTED),
                    f"coalesce(found, CAST(item_id AS VARCHAR)) {NL}", "array_to_string(ht, '::')", f"coalesce(found, CAST(item_id AS VARCHAR)) {NL}", source)


INDEXED = "g AS (SELECT samples.*, k.sid AS found FROM samples LEFT JOIN (SELECT item_id, sid FROM catalogue WHERE c3 <= 40) k USING (item_id))"


def known_sids(spark, sf):
    return catalogue(spark, sf).filter(F.get("codes", F.lit(2)) <= 40).select("item_id", F.col("sid").alias("found_sid"))


@query("task_titles_to_indexed_sid", with_sql(*BASE, INDEXED, "g2 AS (SELECT * FROM g WHERE item_id <> hi[-1])", body=indexed_sid_sql("g2")))
def task_titles_to_indexed_sid(spark, sf):
    return tasks.title_history_to_indexed_sid(samples(spark, sf), KEY, known_sids(spark, sf), drop_repeats=True)


# preferences: the benchmark text of the target stands for what the user is said to like
PREFS = ("prefs AS (SELECT samples.event_id, hi, samples.item_id, benchmark.text AS preference FROM samples JOIN benchmark USING (item_id) WHERE value >= 10)",
         "kn AS (SELECT item_id, sid FROM catalogue WHERE c3 <= 40)",
         "fl AS (SELECT event_id, unnest(hi) AS h, generate_subscripts(hi, 1) AS p FROM prefs)",
         "hh AS (SELECT event_id, string_agg(coalesce(sid, CAST(h AS VARCHAR)), ', ' ORDER BY p) AS hs FROM fl LEFT JOIN kn ON h = kn.item_id GROUP BY 1)",
         "pr AS (SELECT event_id, hs, preference, coalesce(sid, CAST(item_id AS VARCHAR)) AS ts FROM prefs JOIN hh USING (event_id) LEFT JOIN kn USING (item_id))")


def preference_rows(spark, sf):
    from seqloom.sources.readers import preference_histories

    texts = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("user_preference"))
    raw = samples(spark, sf).join(texts, "item_id").select(
        F.col("event_id").cast("string").alias("user"), "user_preference", F.when(F.col("value") >= 10, "train").otherwise("test").alias("split"),
        F.col("history_item").alias("history_items"), F.col("item_id").alias("target_item"))
    rows = preference_histories(raw)
    index = known_sids(spark, sf).withColumnRenamed("item_id", "k")
    sid = F.coalesce("found_sid", F.col("__id").cast("string"))
    mapped = lookups.map_elements(rows, ["user"], "history", index, "k", {"history_sid": sid}, keep_unmapped=True)
    target = mapped.join(index, mapped.target == index.k, "left").withColumn("target_sid", F.coalesce("found_sid", F.col("target").cast("string")))
    return target.select(F.col("user").cast("bigint").alias("event_id"), "history_sid", "target_sid", F.col("user_preference").alias("preference"))


@query("task_reasoning", with_sql(*BASE, *PREFS, body=task_sql(
    "reasoning_to_sid", frame_sql(tasks.REASONING_QUESTION, q(tasks.SID_INSTRUCTION), history="hs"),
    f"{q('### Reasoning:' + chr(10))} || preference || {q(chr(10) + '### Response:' + chr(10))} || ts", "hs", "ts", "pr")))
def task_reasoning(spark, sf):
    return tasks.reasoning_task(preference_rows(spark, sf), KEY)


@query("task_preference_to_sid", with_sql(*BASE, *PREFS, body=task_sql(
    "preference_to_sid", frame_sql(tasks.PREFERENCE_QUESTION, q(tasks.SID_INSTRUCTION), history="hs", preference="preference"), f"ts {NL}", "hs", f"ts {NL}", "pr")))
def task_preference_to_sid(spark, sf):
    return tasks.reasoning_task(preference_rows(spark, sf), KEY, in_prompt=True)


def digest(df):
    """Rows per task and an order-free fingerprint of every prompt and completion."""
    from seqloom.operators.ranking import portable_hash

    return df.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(portable_hash("prompt", "completion")).alias("fingerprint"))


def digest_sql(*parts):
    h = "CAST('0x' || substr(md5(prompt || '|' || completion || '|42'), 1, 15) AS BIGINT)"
    rows = " UNION ALL ".join(f"SELECT task, prompt, completion FROM ({p})" for p in parts)
    return f"SELECT task, count(*) AS n, bit_xor({h}) AS fingerprint FROM ({rows}) GROUP BY 1"


@query("mixture_supervised", with_sql(*BASE, ITEMS, *SHOWN, INDEXED, body=digest_sql(
    sid_next_sql("sid_next_instructed", tasks.SIDS_QUESTION, instruction=q(tasks.SID_INSTRUCTION)),
    pair_sql("sid_to_title", tasks.SID_TO_TITLE, "sid", "title"), pair_sql("title_to_sid", tasks.TITLE_TO_SID, "title", "sid"),
    item_text_sql("sids_to_item_title", tasks.SIDS_TITLE_QUESTION, "coalesce(kt, sid)"), title_next_sql("title_next", TITLE_LINE), indexed_sid_sql("g"))))
def mixture_supervised(spark, sf):
    s, it = materialize(samples(spark, sf), "samples"), items(spark, sf)
    return digest(tasks.mixture(
        tasks.sid_history_to_sid(s, KEY, tasks.SID_INSTRUCTION), tasks.item_identification(it, ["item_id"]),
        tasks.sid_history_to_item_text(s, KEY, known_items(spark, sf), ["item_id"]), tasks.title_history_to_title(s, KEY, CATEGORY),
        tasks.title_history_to_indexed_sid(s, KEY, known_sids(spark, sf))))


@query("mixture_reward_stage", with_sql(*BASE, ITEMS, "d AS (SELECT item_id, sid, CASE WHEN listed THEN title ELSE plain END AS d FROM items)", body=digest_sql(
    sid_next_sql("sid_next", tasks.SIDS_QUESTION), pair_sql("title_to_sid", tasks.TITLE_TO_SID, "title", "sid"),
    pair_sql("description_to_sid", tasks.DESCRIPTION_TO_SID, "d", "sid", "d"), titles_sid_sql("samples"))))
def mixture_reward_stage(spark, sf):
    s, it = materialize(samples(spark, sf), "samples"), items(spark, sf)
    return digest(tasks.mixture(
        tasks.sid_history_to_sid(s, KEY), tasks.item_text_to_sid(it, ["item_id"]),
        tasks.title_history_to_sid(s, KEY, drop_repeats=False)))


@query("task_token_columns", with_sql(*BASE, "t AS (" + sid_next_sql("sid_next", tasks.SIDS_QUESTION) + ")", body="""
    SELECT event_id, CAST(strlen(prompt) + strlen(completion) AS BIGINT) AS tokens, CAST(strlen(completion) AS BIGINT) AS learned FROM t"""))
def task_token_columns(spark, sf):
    rows = tasks.with_tokens(tasks.sid_history_to_sid(samples(spark, sf), KEY), lambda texts: [list(t.encode()) for t in texts])
    return rows.select("event_id", F.size("input_ids").cast("bigint").alias("tokens"),
                       F.size(F.filter("labels", lambda x: x != -100)).cast("bigint").alias("learned"))
