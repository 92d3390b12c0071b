"""Queries for candidates, rewards, policy diagnostics and metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from seqloom.catalog.base import query, with_sql
from seqloom.catalog.inputs import CATALOGUE, HIST, LISTENS, catalogue, listens, table
from seqloom.catalog.interactions import hash_sql
from seqloom.operators import candidates, metrics, ranking, rewards, sequences
from seqloom.plans.dataset import titled_windows

G = 10


def joined(col, sep=","):
    return F.array_join(F.col(col).cast("array<string>"), sep)


# ---- catalogue prefixes (C1-C3) ----
PREFIXES = """pre AS MATERIALIZED (SELECT '' AS prefix, '<a_' || c1 || '>' AS next FROM catalogue UNION SELECT '<a_' || c1 || '>', '<b_' || c2 || '>' FROM catalogue
    UNION SELECT '<a_' || c1 || '><b_' || c2 || '>', '<c_' || c3 || '>' FROM catalogue UNION SELECT sid, '</s>' FROM catalogue)"""


def sid_prefixes(spark, sf):
    return candidates.prefix_rows(catalogue(spark, sf), "tokens")


@query("sid_prefix_rows", with_sql(CATALOGUE, PREFIXES, body="SELECT prefix, next FROM pre"))
def sid_prefix_rows(spark, sf):
    return sid_prefixes(spark, sf)


@query("sid_prefix_map", with_sql(CATALOGUE, PREFIXES, body="SELECT prefix, string_agg(next, ' ' ORDER BY next) AS allowed FROM pre GROUP BY 1"))
def sid_prefix_map(spark, sf):
    return candidates.prefix_map(sid_prefixes(spark, sf)).select("prefix", F.array_join("allowed", " ").alias("allowed"))


@query("title_prefix_rows", """
    WITH w AS (SELECT string_split(text, ' ') || ['</s>'] AS t FROM benchmark UNION ALL SELECT string_split(p_name, ' ') || ['</s>'] FROM part),
    i AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM w)
    SELECT DISTINCT array_to_string(t[1:i - 1], ' ') AS prefix, t[i] AS next FROM i""")
def title_prefix_rows(spark, sf):
    titles = table(spark, sf, "benchmark").select("text").unionByName(table(spark, sf, "part").select(F.col("p_name").alias("text")))
    return candidates.prefix_rows(titles.select(F.split("text", " ").alias("words")), "words", " ")


@query("allowed_next_tokens", with_sql(LISTENS, CATALOGUE, PREFIXES, "m AS (SELECT prefix, string_agg(next, ' ' ORDER BY next) AS allowed FROM pre GROUP BY 1)", body="""
    SELECT event_id, r.prefix, coalesce(allowed, '') AS allowed FROM (SELECT event_id, '<a_' || (item_id % 30) || '>' AS prefix FROM listens) r LEFT JOIN m USING (prefix)"""))
def allowed_next_tokens(spark, sf):
    asked = listens(spark, sf).select("event_id", F.concat(F.lit("<a_"), (F.col("item_id") % 30).cast("string"), F.lit(">")).alias("prefix"))
    out = candidates.allowed_tokens(asked, candidates.prefix_map(sid_prefixes(spark, sf)))
    return out.select("event_id", "prefix", F.array_join("allowed", " ").alias("allowed"))


# ---- token scores: how often a user met a token at each level (W9, C4, C5, T8) ----
TOKEN_SCORES = """tok AS MATERIALIZED (SELECT uid, 0 AS step, '<a_' || c1 || '>' AS token, count(*) AS score FROM listens JOIN catalogue USING (item_id) GROUP BY ALL
    UNION ALL SELECT uid, 1, '<b_' || c2 || '>', count(*) FROM listens JOIN catalogue USING (item_id) GROUP BY ALL
    UNION ALL SELECT uid, 2, '<c_' || c3 || '>', count(*) FROM listens JOIN catalogue USING (item_id) GROUP BY ALL)"""


def token_scores(spark, sf):
    met = listens(spark, sf).join(catalogue(spark, sf).select("item_id", "tokens"), "item_id")
    flat = met.select("uid", F.posexplode("tokens").alias("step", "token"))
    return flat.groupBy("uid", "step", "token").agg(F.count(F.lit(1)).cast("double").alias("score"))


@query("log_softmax_scores", with_sql(LISTENS, CATALOGUE, TOKEN_SCORES, body="""
    SELECT uid, CAST(step AS BIGINT) AS step, token, round(score - (max(score) OVER w + ln(sum(exp(score - mx)) OVER w)), 6) AS logp
    FROM (SELECT *, max(score) OVER (PARTITION BY uid, step) AS mx FROM tok) WINDOW w AS (PARTITION BY uid, step)"""))
def log_softmax_scores(spark, sf):
    out = candidates.log_softmax(token_scores(spark, sf), ["uid", "step"], "score")
    return out.select("uid", F.col("step").cast("bigint").alias("step"), "token", F.round("logp", 6).alias("logp"))


@query("masked_scores", with_sql(LISTENS, CATALOGUE, PREFIXES, TOKEN_SCORES, """
    l AS (SELECT uid, token, score - (mx + ln(sum(exp(score - mx)) OVER (PARTITION BY uid))) AS logp
          FROM (SELECT *, max(score) OVER (PARTITION BY uid) AS mx FROM tok WHERE step = 1))""", """
    r AS (SELECT *, '<a_' || (uid % 30) || '>' AS prefix FROM l)""", body="""
    SELECT uid, token, r.prefix, round(logp + CASE WHEN pre.next IS NULL THEN -1000000 ELSE 0 END, 5) AS masked FROM r LEFT JOIN pre ON r.prefix = pre.prefix AND token = pre.next"""))
def masked_scores(spark, sf):
    step = token_scores(spark, sf).filter("step = 1").drop("step")
    scored = candidates.log_softmax(step, ["uid"], "score").withColumn("prefix", F.concat(F.lit("<a_"), (F.col("uid") % 30).cast("string"), F.lit(">")))
    out = candidates.mask_scores(scored, sid_prefixes(spark, sf), "prefix", "token", "logp")
    return out.select("uid", "token", "prefix", F.round("masked", 5).alias("masked"))


def beam_ctes(beams):
    ctes, prev = ["b0 AS (SELECT DISTINCT uid, '' AS prefix, 0.0::DOUBLE AS total FROM listens)"], "b0"
    for s in range(3):
        ctes.append(f"""b{s + 1} AS MATERIALIZED (SELECT uid, path AS prefix, total FROM (
            SELECT b.uid, b.prefix || p.next AS path, b.total + t.score AS total, row_number() OVER (PARTITION BY b.uid ORDER BY b.total + t.score DESC, b.prefix || p.next) AS rn
            FROM {prev} b JOIN pre p ON b.prefix = p.prefix JOIN tok t ON t.uid = b.uid AND t.step = {s} AND t.token = p.next) WHERE rn <= {beams})""")
        prev = f"b{s + 1}"
    return ctes


def beams(spark, sf, n=20):
    users = listens(spark, sf).select("uid").distinct()
    return candidates.expand_beams(users, catalogue(spark, sf), "tokens", token_scores(spark, sf), "uid", n, 3)


@query("constrained_beams", with_sql(LISTENS, CATALOGUE, PREFIXES, TOKEN_SCORES, *beam_ctes(20), body="""
    SELECT uid, prefix AS sid, total, row_number() OVER (PARTITION BY uid ORDER BY total DESC, prefix) - 1 AS place FROM b3"""))
def constrained_beams(spark, sf):
    return beams(spark, sf)


@query("top_beams", with_sql(LISTENS, CATALOGUE, PREFIXES, TOKEN_SCORES, *beam_ctes(20), body="""
    SELECT uid, string_agg(prefix, ' ' ORDER BY total DESC, prefix) AS beams FROM (
      SELECT *, row_number() OVER (PARTITION BY uid ORDER BY total DESC, prefix) AS rn FROM b3) WHERE rn <= 5 GROUP BY 1"""))
def top_beams(spark, sf):
    lists = beams(spark, sf).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", "sid"))).alias("b"))
    return metrics.top_beams(lists.select("uid", F.col("b.sid").alias("beams")), "beams", 5).select("uid", F.array_join("beams", " ").alias("beams"))


# ---- candidate groups: for each window the history, newest first, answers for the target ----
GROUPS = (f"""w AS MATERIALIZED (SELECT * FROM (SELECT t.*, count(*) OVER x AS n, list(sid) OVER x AS hs, list(item_id) OVER x AS hi
   FROM (SELECT listens.*, title, sid FROM listens JOIN catalogue USING (item_id)) t WINDOW x AS (PARTITION BY uid ORDER BY ts, event_id {HIST})) WHERE n > 0)""",
   """g AS MATERIALIZED (SELECT event_id, uid, sid AS target, item_id AS target_item, value, event_type, unnest(list_reverse(hs)) AS completion, unnest(list_reverse(hi)) AS candidate_item,
   generate_subscripts(hs, 1) - 1 AS pos, hi[-1] AS last_item FROM w)""")
BASE = (LISTENS, CATALOGUE, *GROUPS)


def windows(spark, sf):
    items = catalogue(spark, sf).select("item_id", "title", "sid")
    return titled_windows(listens(spark, sf), items, "uid", ["ts", "event_id"])


def groups(spark, sf):
    newest_first = F.posexplode(F.reverse(F.col("history"))).alias("pos", "h")
    return windows(spark, sf).select(
        "event_id", "uid", F.col("sid").alias("target"), F.col("item_id").alias("target_item"), "value", "event_type",
        F.element_at("history", -1)["item_id"].alias("last_item"), newest_first).select(
        "*", F.col("h.sid").alias("completion"), F.col("h.item_id").alias("candidate_item"), F.col("pos").cast("bigint").alias("p")).drop("h", "pos").withColumnRenamed("p", "pos")


PENALTY = "[" + ", ".join(repr(-(1 / math.log2(i + 2)) / sum(1 / math.log2(j + 2) for j in range(G))) for i in range(G)) + "][CAST(pos AS INTEGER) + 1]"
RULE = "CASE WHEN completion = target THEN 1.0 ELSE 0.0 END"
RANK = f"CASE WHEN max(completion = target) OVER (PARTITION BY event_id) AND completion <> target THEN {PENALTY} ELSE 0.0 END"


def rewarded(spark, sf):
    g = groups(spark, sf).withColumn("rule_reward", rewards.exact_match("completion", "target"))
    return rewards.rank_penalty(g, ["event_id"], "pos", "completion", "target", G)


REWARDED = f"rw AS MATERIALIZED (SELECT *, CAST({RULE} AS DOUBLE) AS rule_reward, CAST({RANK} AS DOUBLE) AS rank_reward FROM g)"


@query("reward_rule_and_rank", with_sql(*BASE, REWARDED, body="""
    SELECT event_id, pos, completion, rule_reward, round(rank_reward, 9) AS rank_reward FROM rw"""))
def reward_rule_and_rank(spark, sf):
    return rewarded(spark, sf).select("event_id", "pos", "completion", "rule_reward", F.round("rank_reward", 9).alias("rank_reward"))


@query("advantages", with_sql(*BASE, REWARDED, """tot AS (SELECT event_id, pos, rule_reward + rank_reward AS r FROM rw)""", body="""
    SELECT event_id, pos, round(r, 9) AS reward, round((r - avg(r) OVER q) / (stddev_samp(r) OVER q + 1e-4), 5) AS advantage FROM tot WINDOW q AS (PARTITION BY event_id)"""))
def advantages(spark, sf):
    total = rewarded(spark, sf).withColumn("reward", rewards.weighted_sum(rewards.reward_columns("ranking")))
    out = rewards.advantages(total, ["event_id"], "reward")
    return out.select("event_id", "pos", F.round("reward", 9).alias("reward"), F.round("advantage", 5).alias("advantage"))


# besides all candidates, two rows a group that no vector belongs to: an unknown id and none at all
UNKNOWN = """more AS (SELECT event_id, CAST(pos AS BIGINT) AS pos, target_item, candidate_item FROM g
    UNION ALL SELECT event_id, 100, target_item, -1 - event_id FROM g WHERE pos = 0 UNION ALL SELECT event_id, 101, target_item, NULL FROM g WHERE pos = 0)"""


@query("reward_semantic", with_sql(*BASE, "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", UNKNOWN, body="""
    SELECT event_id, pos, coalesce(round(list_cosine_similarity(a.e, b.e), 5), 0.0) AS semantic_reward FROM more
    LEFT JOIN v a ON a.vec_id = target_item LEFT JOIN v b ON b.vec_id = candidate_item"""))
def reward_semantic(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    g = groups(spark, sf).select("event_id", F.col("pos").cast("bigint").alias("pos"), "target_item", "candidate_item")
    first = g.filter("pos = 0").select("event_id", "target_item")
    unknown = first.selectExpr("event_id", "100L AS pos", "target_item", "-1 - event_id AS candidate_item")
    none = first.selectExpr("event_id", "101L AS pos", "target_item", "CAST(NULL AS BIGINT) AS candidate_item")
    out = rewards.semantic_reward(g.unionByName(unknown).unionByName(none), vectors, "target_item", "candidate_item")
    return out.select("event_id", "pos", F.round("semantic_reward", 5).alias("semantic_reward"))


DRAW = hash_sql("event_id", "pos") + " % (SELECT count(*) FROM catalogue)"


@query("reward_collaborative", with_sql(*BASE, "tr AS (SELECT hi[-1] AS last, item_id AS nxt, CAST(count(*) AS DOUBLE) AS score FROM w GROUP BY 1, 2)", f"""
    c AS (SELECT event_id, pos, last_item, CASE WHEN candidate_item IN (SELECT item_id FROM benchmark) THEN candidate_item ELSE {DRAW} END AS cand FROM g)""", body="""
    SELECT event_id, pos, coalesce(score, 0.0) AS collaborative_reward FROM c LEFT JOIN tr ON last = last_item AND nxt = cand"""))
def reward_collaborative(spark, sf):
    w = windows(spark, sf).select(F.element_at("history", -1)["item_id"].alias("last"), "item_id")
    scores = rewards.transition_scores(w, "last", "item_id")
    known = table(spark, sf, "benchmark").select(F.col("item_id").alias("candidate_item"), F.col("item_id").alias("known"))
    g = groups(spark, sf).join(known, "candidate_item", "left")
    n = catalogue(spark, sf).count()
    return rewards.collaborative_reward(g, scores, "last_item", "known", n, ["event_id", "pos"]).select("event_id", "pos", "collaborative_reward")


# every reward by its name, and one that the caller writes: 1 where the first level of the code is right
BY_NAME = (REWARDED, "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
    "tr AS (SELECT hi[-1] AS last, item_id AS nxt, CAST(count(*) AS DOUBLE) AS score FROM w GROUP BY 1, 2)",
    f"c AS (SELECT *, CASE WHEN candidate_item IN (SELECT item_id FROM benchmark) THEN candidate_item ELSE {DRAW} END AS cand FROM rw)",
    """s AS (SELECT c.*, coalesce(list_cosine_similarity(a.e, b.e), 0.0) AS semantic, coalesce(score, 0.0) AS sasrec FROM c LEFT JOIN v a ON a.vec_id = target_item
      LEFT JOIN v b ON b.vec_id = candidate_item LEFT JOIN tr ON last = last_item AND nxt = cand)""")


def first_level_right(prompts, completions, target):
    return [float(c.split(">")[0] == t.split(">")[0]) for c, t in zip(completions, target)]


@query("rewards_by_name", with_sql(*BASE, *BY_NAME, body="""
    SELECT event_id, pos, kind, round(r, 5) AS reward FROM (
      SELECT event_id, pos, unnest(['rule', 'ranking', 'ranking_only', 'semantic', 'sasrec', 'first_level']) AS kind,
             unnest([rule_reward, rule_reward + rank_reward, rank_reward, semantic, sasrec,
                     CASE WHEN split_part(completion, '>', 1) = split_part(target, '>', 1) THEN 1.0 ELSE 0.0 END]) AS r FROM s)"""))
def rewards_by_name(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    scores = rewards.transition_scores(windows(spark, sf).select(F.element_at("history", -1)["item_id"].alias("last"), "item_id"), "last", "item_id")
    known = table(spark, sf, "benchmark").select(F.col("item_id").alias("candidate_item"), F.col("item_id").alias("known"))
    g = rewards.semantic_reward(rewarded(spark, sf), vectors, "target_item", "candidate_item").join(known, "candidate_item", "left")
    g = rewards.collaborative_reward(g, scores, "last_item", "known", catalogue(spark, sf).count(), ["event_id", "pos"])
    own = {"first_level": lambda: rewards.caller_reward(first_level_right, "event_id", "completion", "target")}
    g = g.withColumns({name: make() for name, make in own.items()})
    kinds = [*rewards.REWARD_SETS, *own]
    totals = [F.struct(F.lit(k).alias("kind"), F.round(rewards.weighted_sum(rewards.reward_columns(k, own)), 5).alias("reward")) for k in kinds]
    return g.select("event_id", "pos", F.explode(F.array(*totals)).alias("k")).select("event_id", "pos", "k.kind", "k.reward")


@query("selected_completions", with_sql(*BASE, "c AS (SELECT event_id, completion, target, count(*) AS n, min(pos) AS f FROM g GROUP BY ALL)",
    "r AS (SELECT *, unnest(range(1, n + 1)) AS round FROM c)", """
    o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY completion = target DESC, CASE WHEN completion = target THEN 0 ELSE round END, n DESC, f, round) AS rn FROM r)""",
    body="SELECT event_id, completion, target, round, n FROM o WHERE rn <= 6"))
def selected_completions(spark, sf):
    return rewards.select_completions(groups(spark, sf), ["event_id"], "pos", "completion", "target", 6)


@query("target_injected", with_sql(*BASE, body="SELECT event_id, pos, CASE WHEN pos = 9 THEN target ELSE completion END AS completion FROM g"))
def target_injected(spark, sf):
    return rewards.inject_target(groups(spark, sf), "pos", "completion", "target", G).select("event_id", "pos", "completion")


@query("diversity", with_sql(*BASE, "d AS (SELECT event_id, count(DISTINCT completion) AS d FROM g GROUP BY 1)",
    "t AS (SELECT unnest(hi) AS t FROM w)", body="""
    SELECT round(avg(d / 10.0), 9) AS completion_diversity, count(*) AS groups, (SELECT round(count(DISTINCT t) / count(*), 9) FROM t WHERE t <> 0) AS token_diversity FROM d"""))
def diversity(spark, sf):
    per = rewards.completion_diversity(groups(spark, sf), ["event_id"], "completion", G)
    tok = rewards.token_diversity(windows(spark, sf).withColumn("tokens", sequences.history_of("item_id")), "tokens", F.lit(0))
    # two one-row tables, joined on a constant
    both = per.withColumn("one", F.lit(1)).join(tok.withColumn("one", F.lit(1)), "one")
    return both.select(F.round("completion_diversity", 9).alias("completion_diversity"), "groups", F.round("token_diversity", 9).alias("token_diversity"))


# ---- policy diagnostics: log-probabilities made from the values in the history ----
POLICY = (LISTENS, f"""pw AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER x AS n, list(value) OVER x AS hv, list(item_id) OVER x AS hi, list(ts) OVER x AS ht
   FROM listens WINDOW x AS (PARTITION BY uid ORDER BY ts, event_id {HIST})) WHERE n > 0)""",
   """pt AS MATERIALIZED (SELECT event_id, CAST((item_id % 5) - 2 AS DOUBLE) AS adv, -v / 100 AS c, -(v + i % 7) / 100 AS r, -(v + i % 3) / 100 AS o, m FROM (
      SELECT event_id, item_id, unnest(hv) AS v, unnest(hi) AS i, CAST(generate_subscripts(hv, 1) <= 8 AS DOUBLE) AS m FROM pw))""",
   "pk AS MATERIALIZED (SELECT *, exp(r - c) - (r - c) - 1 AS k FROM pt)")


def policy_rows(spark, sf):
    w = sequences.sliding_windows(listens(spark, sf), "uid", ["ts", "event_id"], ["value", "item_id"])

    def logp(shift):
        return F.transform("history", lambda h: -(h["value"] + (h["item_id"] % shift if shift else 0)) / 100)

    mask = F.transform("history", lambda h, i: F.when(i < 8, 1.0).otherwise(0.0))
    return w.select("event_id", (F.col("item_id") % 5 - 2.0).alias("advantage"), logp(0).alias("logp"), logp(7).alias("ref"), logp(3).alias("old"), mask.alias("mask"))


@query("kl_per_sequence", with_sql(*POLICY, body="""
    SELECT event_id, sum(m) AS completion_length, round(sum(k * m) / sum(m), 8) AS kl FROM pk GROUP BY 1"""))
def kl_per_sequence(spark, sf):
    out = rewards.kl_per_sequence(policy_rows(spark, sf), "logp", "ref", "mask")
    return out.select("event_id", "completion_length", F.round("kl", 8).alias("kl"))


@query("objective_values", with_sql(*POLICY, """s AS (SELECT event_id, max(adv) AS adv, sum(m) AS n, sum(-(exp(c - o) * adv - 0.04 * k) * m) AS loss,
      sum((c - o) * m) AS lr, sum(k * m) AS kk FROM pk GROUP BY 1)""", body="""
    SELECT round(avg(loss / n), 8) AS per_sequence, round(sum(loss) / sum(n), 8) AS per_token, round(avg(-(exp(lr / n) * adv - 0.04 * kk / n)), 8) AS sequence_ratio FROM s"""))
def objective_values(spark, sf):
    out = rewards.objective(policy_rows(spark, sf), "logp", "old", "ref", "mask", "advantage")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query("reward_log", with_sql(*BASE, REWARDED, "s AS (SELECT event_id, stddev_samp(rule_reward + rank_reward) AS sd FROM rw GROUP BY 1)", body="""
    SELECT round(avg(rule_reward), 8) AS mean_rule_reward, round(avg(rank_reward), 8) AS mean_rank_reward, round(avg(rule_reward + rank_reward), 8) AS mean_reward,
      (SELECT round(avg(sd), 8) FROM s) AS reward_std FROM rw"""))
def reward_log(spark, sf):
    total = rewarded(spark, sf).withColumn("reward", rewards.weighted_sum(["rule_reward", "rank_reward"]))
    out = rewards.reward_log(total, ["event_id"], ["rule_reward", "rank_reward"], "reward")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


# ---- metrics ----
PREDICTIONS = "p AS (SELECT event_id, uid, sid AS target, list_reverse(hs) AS predict, event_type FROM w)"
PLACED = "pl AS (SELECT event_id, uid, event_type, len(predict) AS beams, CASE WHEN list_position(predict, target) > 0 THEN list_position(predict, target) - 1 END AS place FROM p)"


def metric_sql(ks, source="pl"):
    return " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS k, round(avg(CASE WHEN place < {k} THEN 1.0 ELSE 0.0 END), 8) AS hr, "
        f"round(avg(CASE WHEN place < {k} THEN 1 / log2(place + 2) ELSE 0.0 END), 8) AS ndcg FROM {source}" for k in ks)


def ranked_sql(ks):
    """Each K over the requests with at least K answers."""
    return " UNION ALL ".join(
        f"SELECT CAST({k} AS BIGINT) AS k, count(*) AS requests, round(avg(CASE WHEN place < {k} THEN 1.0 ELSE 0.0 END), 8) AS hr, "
        f"round(avg(CASE WHEN place < {k} THEN 1 / log2(place + 2) ELSE 0.0 END), 8) AS ndcg FROM pl WHERE beams >= {k} HAVING count(*) > 0" for k in ks)


def predictions(spark, sf):
    """All windows as prediction records: answers quoted as a generator would print them."""
    answers = F.transform(F.reverse(sequences.history_of("sid")), lambda s: F.concat(F.lit('"'), s, F.lit('"\n')))
    return windows(spark, sf).select(
        "event_id", "uid", "event_type", F.concat("sid", F.lit("\n")).alias("target"), answers.alias("predict"))


def rounded(df, *keep):
    return df.select("k", *keep, F.round("hr", 8).alias("hr"), F.round("ndcg", 8).alias("ndcg"))


@query("metrics_ranked", with_sql(*BASE, PREDICTIONS, PLACED, body=ranked_sql((1, 3, 5, 10, 20, 50))))
def metrics_ranked(spark, sf):
    listed = predictions(spark, sf).withColumn("target", F.array("target"))
    return rounded(metrics.ranked_metrics(listed, "predict", "target"), "requests")


@query("metrics_one_per_group", with_sql(*BASE, PREDICTIONS, PLACED, body=ranked_sql((3, 5, 10, 20))))
def metrics_one_per_group(spark, sf):
    from seqloom.operators.sampling import repeated

    many = repeated(predictions(spark, sf), 4)
    return rounded(metrics.ranked_metrics(metrics.one_per_group(many, ["event_id"], "predict", "target"), "predict", "target", metrics.TRAINING_KS), "requests")


@query("invalid_before_hit", with_sql(*BASE, PREDICTIONS, """
    s AS (SELECT unnest(CASE WHEN list_position(predict, target) > 0 THEN predict[1:list_position(predict, target)] ELSE predict END) AS a FROM p)""", body="""
    SELECT count(*) AS invalid FROM s WHERE a NOT IN (SELECT sid FROM catalogue JOIN benchmark USING (item_id))"""))
def invalid_before_hit(spark, sf):
    known = catalogue(spark, sf).join(table(spark, sf, "benchmark").select("item_id"), "item_id", "left_semi")
    return metrics.invalid_before_hit(predictions(spark, sf), "predict", "target", known, "sid")


USER_SCORES = """us AS MATERIALIZED (SELECT uid, item_id, sum(CAST(round(value * 100) AS BIGINT)) AS score FROM listens GROUP BY 1, 2)""", """
    tg AS (SELECT uid, arg_max(item_id, ts) AS t, arg_max(event_type, ts) AS kind FROM listens GROUP BY 1)""", """
    pl AS (SELECT tg.uid, max(kind) AS kind, count(*) FILTER (us.score > o.score OR (us.score = o.score AND us.item_id < t)) AS place
      FROM tg JOIN us o ON o.uid = tg.uid AND o.item_id = t JOIN us ON us.uid = tg.uid GROUP BY 1)"""


def user_places(spark, sf):
    rows = listens(spark, sf)
    scores = rows.groupBy("uid", "item_id").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("score"))
    last = rows.groupBy("uid").agg(F.max_by(F.struct("item_id", "event_type"), F.struct("ts", "event_id")).alias("t")).select("uid", "t.*")
    return metrics.target_places(scores, last, "uid", "item_id", "score").join(last.select("uid", "event_type"), "uid")


@query("target_ranks", with_sql(LISTENS, *USER_SCORES, body="SELECT uid, place FROM pl"))
def target_ranks(spark, sf):
    return user_places(spark, sf).select("uid", "place")


@query("metrics_full_scores", with_sql(LISTENS, *USER_SCORES, body=metric_sql((1, 3, 5, 10, 20))))
def metrics_full_scores(spark, sf):
    return rounded(metrics.score_metrics(user_places(spark, sf)))


BEHAVIOUR = " UNION ALL ".join(f"""SELECT CAST({k} AS BIGINT) AS k, round(sum(CASE WHEN place < {k} THEN r ELSE 0.0 END), 6) AS total_reward,
    count(*) FILTER (place < {k} AND r = 0.2) AS hit_click, round(sum(CASE WHEN place < {k} AND r = 0.2 THEN 1 / log2(place + 2) ELSE 0.0 END), 6) AS ndcg_click,
    count(*) FILTER (place < {k} AND r <> 0.2) AS hit_purchase, round(sum(CASE WHEN place < {k} AND r <> 0.2 THEN 1 / log2(place + 2) ELSE 0.0 END), 6) AS ndcg_purchase
    FROM (SELECT place, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS r FROM pl WHERE event_type IN ('click', 'purchase'))""" for k in (5, 10))


@query("metrics_by_behaviour", with_sql(*BASE, PREDICTIONS, PLACED, body=BEHAVIOUR))
def metrics_by_behaviour(spark, sf):
    p = predictions(spark, sf).filter(F.col("event_type").isin("click", "purchase"))
    placed = p.select(metrics.hit_place(metrics.clean_answers("predict"), F.btrim("target", F.lit("\n"))).alias("place"),
                      F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.2).alias("reward"))
    out = metrics.behaviour_metrics(placed, "reward", 0.2, (5, 10))
    return out.withColumns({c: F.round(c, 6) for c in ("total_reward", "ndcg_click", "ndcg_purchase")})


@query("metrics_sharded", with_sql(*BASE, PREDICTIONS, PLACED,
    "sh AS (SELECT place, ((row_number() OVER (ORDER BY event_id)) * 4 - 1) // count(*) OVER () AS shard FROM pl)", body="""
    SELECT CAST(shard AS BIGINT) AS shard, count(*) AS n, round(avg(CASE WHEN place < 5 THEN 1.0 ELSE 0.0 END), 8) AS hr5 FROM sh GROUP BY 1"""))
def metrics_sharded(spark, sf):
    sharded = ranking.contiguous_shards(predictions(spark, sf), ["event_id"], 4)
    place = metrics.hit_place(metrics.clean_answers("predict"), F.btrim("target", F.lit("\n")))
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(place < 5, 1.0).otherwise(0.0)), 8).alias("hr5"))
