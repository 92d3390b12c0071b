"""Queries for semantic IDs: codes, collisions, quantisation and balanced assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.catalog.base import query, with_sql
from seqloom.catalog.inputs import CATALOGUE, catalogue, table
from seqloom.functions import arrays, sids
from seqloom.operators import aggregates, balance, clusters, collisions, quantize
from seqloom.operators.ranking import dense_ids
from seqloom.operators.tiles import book_of
from seqloom.plans.sid_index import sid_index
from seqloom.session import durable_path, materialize
from seqloom.sources import writers
from seqloom.sources.readers import read_json_lines, sanitized_stats

CLASSES, LEVELS, DIM = 8, 3, 64


def joined(col, sep=","):
    return F.array_join(F.col(col).cast("array<string>"), sep)


def vectors(spark, sf):
    return quantize.as_doubles(table(spark, sf, "embeddings"), "vec_id", "embedding")


def class_codebooks(spark, sf, levels=LEVELS):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    dense = dense_ids(rows.select("label").distinct(), ["label"], "code")
    classes = rows.join(dense, "label").select("item_id", F.col("code").cast("int").alias("code"))
    return quantize.codebooks_from_classes(vectors(spark, sf), classes, levels)


def quantizer_ctes(levels: int = LEVELS) -> list[str]:
    """The class-mean residual quantiser in SQL, one row per (vector, dimension)."""
    ctes = ["""cls AS MATERIALIZED (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM embeddings))""",
            """r0 AS MATERIALIZED (SELECT vec_id, code AS cls, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x
               FROM embeddings JOIN cls USING (label))"""]
    for level in range(levels):
        ctes += [
            f"b{level} AS MATERIALIZED (SELECT cls AS code, d, avg(x) AS c FROM r{level} GROUP BY 1, 2)",
            f"d{level} AS MATERIALIZED (SELECT vec_id, b.code, sum((x - c) * (x - c)) AS dist FROM r{level} r JOIN b{level} b USING (d) GROUP BY 1, 2)",
            f"k{level} AS MATERIALIZED (SELECT vec_id, arg_min(code, dist) AS code FROM d{level} GROUP BY 1)",
            f"r{level + 1} AS MATERIALIZED (SELECT vec_id, cls, d, x - c AS x FROM r{level} JOIN k{level} USING (vec_id) JOIN b{level} b USING (code, d))"]
    return ctes


# ---- tokens ----
@query("sid_tokens", with_sql(CATALOGUE, body="""
    SELECT item_id, sid, '<a_' || (c1 + 1) || '> <b_' || (c2 + 1) || '> <c_' || (c3 + 1) || '>' AS one_based,
           '<|a_' || c1 || '|><|b_' || c2 || '|><|c_' || c3 || '|>' AS piped, '<a_' || c1 || '><b_' || c2 || '>' AS two_levels FROM catalogue"""))
def sid_tokens(spark, sf):
    return catalogue(spark, sf).select(
        "item_id", "sid", F.array_join(sids.tokens("codes", 1), " ").alias("one_based"),
        sids.sid(sids.tokens("codes", 0, sids.PIPE_TOKEN)).alias("piped"), sids.sid_prefix("tokens", 2).alias("two_levels"))


@query("sid_parsed", with_sql(CATALOGUE, body="""
    SELECT item_id, 3::BIGINT AS levels, '<b_' || c2 || '>' AS second, c3 AS third FROM catalogue"""))
def sid_parsed(spark, sf):
    parsed = catalogue(spark, sf).select("item_id", sids.parse_sid("sid").alias("t"), sids.parse_codes("sid", 0).alias("c"))
    return parsed.select("item_id", F.size("t").cast("bigint").alias("levels"), F.get("t", F.lit(1)).alias("second"),
                         F.get("c", F.lit(2)).cast("bigint").alias("third"))


@query("unpacked_codes", """
    SELECT o_orderkey, (w & 63) AS l0, ((w >> 6) & 63) AS l1, ((w >> 12) & 63) AS l2 FROM (
      SELECT o_orderkey, o_orderkey * 1009 + o_custkey AS w FROM orders)""")
def unpacked_codes(spark, sf):
    word = F.col("o_orderkey") * 1009 + F.col("o_custkey")
    out = table(spark, sf, "orders").select("o_orderkey", sids.unpack(word, 6, 3).alias("c"))
    return out.select("o_orderkey", *[F.get("c", F.lit(i)).cast("bigint").alias(f"l{i}") for i in range(3)])


@query("sid_vocabulary", with_sql(CATALOGUE, body="""
    SELECT '<a_' || c1 || '>' AS token FROM catalogue GROUP BY 1 UNION ALL SELECT '<b_' || c2 || '>' FROM catalogue GROUP BY 1
    UNION ALL SELECT '<c_' || c3 || '>' FROM catalogue GROUP BY 1"""))
def sid_vocabulary(spark, sf):
    return aggregates.vocabulary(catalogue(spark, sf), "tokens")


# ---- collisions ----
@query("collision_suffix", with_sql(CATALOGUE, body="""
    SELECT item_id, c1 || ',' || c2 || ',' || c3 || CASE WHEN count(*) OVER p > 1
      THEN ',' || row_number() OVER (PARTITION BY c1, c2, c3 ORDER BY item_id) ELSE '' END AS codes
    FROM catalogue WINDOW p AS (PARTITION BY c1, c2, c3)"""))
def collision_suffix(spark, sf):
    out = aggregates.suffix_collisions(catalogue(spark, sf).select("item_id", "codes"), "item_id", "codes")
    return out.select("item_id", joined("codes").alias("codes"))


@query("collision_report", with_sql(CATALOGUE, "g AS (SELECT count(*) AS n FROM catalogue GROUP BY c1, c2, c3)", body="""
    SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS paths, count(*) FILTER (n > 1) AS collided_paths, CAST(sum(n - 1) AS BIGINT) AS surplus,
           max(n) AS largest, round(1 - count(*) / sum(n), 9) AS collision_rate, sum(n - 1) = 0 AS all_unique FROM g"""))
def collision_report(spark, sf):
    return aggregates.collision_report(catalogue(spark, sf), "codes").withColumn("collision_rate", F.round("collision_rate", 9))


@query("collided_members", with_sql(CATALOGUE, body="""
    SELECT item_id, sid, n AS members FROM catalogue JOIN (SELECT sid, count(*) AS n FROM catalogue GROUP BY 1 HAVING count(*) > 1) USING (sid)"""))
def collided_members(spark, sf):
    return aggregates.collided_members(catalogue(spark, sf), "item_id", "sid").select("item_id", "sid", "members")


@query("codes_per_level", with_sql(CATALOGUE, "f AS (SELECT 0 AS level, c1 AS c FROM catalogue UNION ALL SELECT 1, c2 FROM catalogue UNION ALL SELECT 2, c3 FROM catalogue)",
    "g AS (SELECT level, c, count(*) AS n FROM f GROUP BY 1, 2)", body="""
    SELECT CAST(level AS BIGINT) AS level, count(*) AS unique_codes, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean_size FROM g GROUP BY 1"""))
def codes_per_level(spark, sf):
    out = aggregates.codes_per_level(catalogue(spark, sf), "codes")
    return out.withColumn("level", F.col("level").cast("bigint")).withColumn("mean_size", F.round("mean_size", 6))


@query("cluster_sizes", """
    SELECT count(*) AS clusters, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean_size FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)""")
def cluster_sizes(spark, sf):
    out = aggregates.per_level_code_sizes(table(spark, sf, "embeddings"), F.col("label"))
    return out.withColumn("mean_size", F.round("mean_size", 6))


# ---- vectors ----
NOISY = """noisy AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@query("sanitized_vectors", with_sql(NOISY, body="""
    SELECT count(DISTINCT vec_id) AS rows, count(*) FILTER (x > 0.3) AS nan_values, count(*) FILTER (x < -0.3) AS inf_values,
           round(min(CASE WHEN abs(x) > 0.3 THEN 0 ELSE x END), 6) AS min, round(max(CASE WHEN abs(x) > 0.3 THEN 0 ELSE x END), 6) AS max,
           round(avg(CASE WHEN abs(x) > 0.3 THEN 0 ELSE x END), 6) AS mean FROM noisy"""))
def sanitized_vectors(spark, sf):
    spoiled = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.3, F.lit(float("nan")).cast("float"))
                          .when(x.cast("double") < -0.3, F.lit(float("-inf")).cast("float")).otherwise(x))
    stats = sanitized_stats(table(spark, sf, "embeddings").select(spoiled.alias("embedding")), "embedding")
    return stats.withColumns({c: F.round(c, 6) for c in ("min", "max", "mean")})


@query("vector_similarity", with_sql("m AS (SELECT label, min(vec_id) AS anchor FROM embeddings GROUP BY 1)", """
    pairs AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS a, CAST(f.embedding AS DOUBLE[]) AS b
    FROM embeddings e JOIN m USING (label) JOIN embeddings f ON f.vec_id = anchor)""", body="""
    SELECT vec_id, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_distance(a, b) * list_distance(a, b), 6) AS sq_distance FROM pairs"""))
def vector_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    anchors = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    both = e.join(anchors, "label")
    return both.select("vec_id", F.round(arrays.cosine("embedding", "anchor"), 6).alias("cosine"),
                       F.round(arrays.squared_distance("embedding", "anchor"), 6).alias("sq_distance"))


@query("masked_mean_pooling", with_sql("t AS (SELECT label, embedding, embedding[1] > 0 AS keep FROM embeddings)", """
    f AS (SELECT label, keep, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM t)""", """
    g AS (SELECT label, d, sum(CASE WHEN keep THEN x ELSE 0 END) / greatest(count(*) FILTER (keep), 1e-9) AS m FROM f GROUP BY 1, 2)""", body="""
    SELECT CAST(label AS BIGINT) AS label, CAST(d AS BIGINT) AS d, round(m, 6) AS mean FROM g"""))
def masked_mean_pooling(spark, sf):
    tokens = table(spark, sf, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("vec"), (F.get("embedding", F.lit(0)) > 0).cast("int").alias("mask"))
    out = quantize.masked_mean(tokens, "label", "vec", "mask", DIM)
    flat = out.select(F.col("label").cast("bigint").alias("label"), F.posexplode("embedding").alias("p", "x"))
    return flat.select("label", (F.col("p") + 1).cast("bigint").alias("d"), F.round("x", 6).alias("mean"))


@query("codebook_centroids", with_sql(*quantizer_ctes(2), body="""
    SELECT CAST(0 AS BIGINT) AS level, code, CAST(d AS BIGINT) AS d, round(c, 6) AS x FROM b0 UNION ALL SELECT 1, code, d, round(c, 6) FROM b1"""))
def codebook_centroids(spark, sf):
    flat = class_codebooks(spark, sf, 2).select("level", "code", F.posexplode("centroid").alias("p", "x"))
    return flat.select(F.col("level").cast("bigint").alias("level"), F.col("code").cast("bigint").alias("code"),
                       (F.col("p") + 1).cast("bigint").alias("d"), F.round("x", 6).alias("x"))


@query("encoded_vectors", with_sql(*quantizer_ctes(), body="""
    SELECT vec_id AS item_id, k0.code || ',' || k1.code || ',' || k2.code AS codes FROM k0 JOIN k1 USING (vec_id) JOIN k2 USING (vec_id)"""))
def encoded_vectors(spark, sf):
    return quantize.encode(vectors(spark, sf), class_codebooks(spark, sf)).select("item_id", joined("codes").alias("codes"))


@query("encoded_vectors_blockwise", with_sql(*quantizer_ctes(), body="""
    SELECT vec_id AS item_id, k0.code || ',' || k1.code || ',' || k2.code AS codes FROM k0 JOIN k1 USING (vec_id) JOIN k2 USING (vec_id)"""))
def encoded_vectors_blockwise(spark, sf):
    """The same encoding with parts of three codes, so that every codebook takes several passes."""
    out = quantize.encode(vectors(spark, sf), class_codebooks(spark, sf), part_bytes=3 * DIM * 8)
    return out.select("item_id", joined("codes").alias("codes"))


@query("quantizer_errors", with_sql(*quantizer_ctes(), "e AS (" + " UNION ALL ".join(
    f"SELECT {i} AS level, (SELECT avg(x * x) FROM r{i}) AS b, (SELECT avg(x * x) FROM r{i + 1}) AS a" for i in range(LEVELS)) + ")", body="""
    SELECT CAST(level AS BIGINT) AS level, round(b, 6) AS mse_before, round(a, 6) AS mse_after, round(a * 1.25, 6) AS loss FROM e"""))
def quantizer_errors(spark, sf):
    books = class_codebooks(spark, sf)
    v = vectors(spark, sf)
    out = quantize.level_errors(v, quantize.encode(v, books), books)
    return out.select(F.col("level").cast("bigint").alias("level"), *[F.round(c, 6).alias(c) for c in ("mse_before", "mse_after", "loss")])


@query("balancing_temperature", with_sql(*quantizer_ctes(1), """
    s AS (SELECT vec_id, quantile_cont(dist - lo, 0.9) AS q FROM (SELECT vec_id, dist, min(dist) OVER (PARTITION BY vec_id) AS lo FROM d0) GROUP BY 1)""", body="""
    SELECT round(greatest(0.1 * median(q), 1e-6), 6) AS tau FROM s"""))
def balancing_temperature(spark, sf):
    tau = balance.temperature(vectors(spark, sf), book_of(spark, class_codebooks(spark, sf, 1)))
    return spark.range(1).select(F.round(F.lit(tau), 6).alias("tau"))


SINK_ITERS, SINK_TAU = 6, 0.05


def sinkhorn_ctes() -> list[str]:
    """Row and column scalings unrolled in log-free form: v starts at 1 and every round is one CTE."""
    ctes = ["n AS (SELECT count(*) AS n, (SELECT count(*) FROM cls) AS k FROM embeddings)",
            """cap AS (SELECT code, (n // k + CASE WHEN code < n % k THEN 1 ELSE 0 END) AS cap, n FROM cls, n)""",
            f"ker AS MATERIALIZED (SELECT vec_id, code, exp(-(dist - min(dist) OVER (PARTITION BY vec_id)) / {SINK_TAU}) AS g FROM d0)",
            "v0 AS (SELECT code, 1.0::DOUBLE AS v FROM cls)"]
    for i in range(SINK_ITERS):
        ctes += [f"u{i} AS MATERIALIZED (SELECT vec_id, 1 / sum(g * v) AS u FROM ker JOIN v{i} USING (code) GROUP BY 1)",
                 f"v{i + 1} AS MATERIALIZED (SELECT code, (max(cap) / max(n)) / (sum(g * u) / max(n)) AS v "
                 f"FROM ker JOIN u{i} USING (vec_id) JOIN cap USING (code) GROUP BY 1)"]
    return ctes


@query("sinkhorn_scalings", with_sql(*quantizer_ctes(1), *sinkhorn_ctes(), body=f"""
    SELECT code, round(ln(v), 6) AS log_scaling FROM v{SINK_ITERS}"""))
def sinkhorn_scalings(spark, sf):
    v = vectors(spark, sf)
    book = book_of(spark, class_codebooks(spark, sf, 1))
    caps = balance.even_capacities(v.count(), book.size)
    bias = balance.sinkhorn_bias(v, book, caps, SINK_TAU, SINK_ITERS)
    rows = v.sparkSession.createDataFrame([(i, float(b)) for i, b in enumerate(bias)], "code bigint, b double")
    return rows.select("code", F.round("b", 6).alias("log_scaling"))


# one item at a time, in hash order, each takes the nearest code with room left
GREEDY = """
  pref AS MATERIALIZED (SELECT vec_id, list(code ORDER BY dist) AS p FROM d0 GROUP BY 1),
  turn AS MATERIALIZED (SELECT vec_id, p, row_number() OVER (ORDER BY CAST('0x' || substr(md5(vec_id || '|42'), 1, 15) AS BIGINT), vec_id) AS t FROM pref),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS code, (SELECT list(CAST(cap AS BIGINT) ORDER BY code) FROM cap) AS room
    UNION ALL
    SELECT s.t, s.vec_id, s.c, list_transform(s.room, lambda x, i: CASE WHEN i = s.c + 1 THEN x - 1 ELSE x END) FROM (
      SELECT turn.t, turn.vec_id, walk.room, list_filter(turn.p, lambda q: walk.room[CAST(q AS INTEGER) + 1] > 0)[1] AS c FROM walk JOIN turn ON turn.t = walk.t + 1) s)"""


@query("capacity_assignment", "WITH RECURSIVE " + ",\n".join([*quantizer_ctes(1), *sinkhorn_ctes()[:2], GREEDY]) +
       "\nSELECT vec_id AS item_id, code FROM walk WHERE vec_id IS NOT NULL")
def capacity_assignment(spark, sf):
    v = vectors(spark, sf)
    book = book_of(spark, class_codebooks(spark, sf, 1))
    out = balance.capacity_assign(v, book, balance.even_capacities(v.count(), book.size))
    return out.select("item_id", F.col("code").cast("bigint").alias("code"))


# ---- fitted quantisers: codes of every item with the errors of the fit; tests/test_fitted.py compares them with numpy ----
def with_errors(codes, books, v, **plain):
    """Codes as text, and per item the same mean squared errors: of the codes, and of others for comparison."""
    out = codes.select("item_id", joined("codes").alias("codes"))
    for name, other in {"mse": codes, **plain}.items():
        last = quantize.level_errors(v, other, books).orderBy(F.desc("level")).first()["mse_after"]
        out = out.withColumn(name, F.round(F.lit(last), 9))
    return out


@query("residual_kmeans_codes")
def residual_kmeans_codes(spark, sf):
    """Codes of a fit of three levels, and the mean squared error they leave."""
    v = vectors(spark, sf)
    books, codes = quantize.fit_residual_kmeans(v, 16, 3, max_iter=100)
    return with_errors(codes, books, v)


@query("sid_index_from_vectors")
def sid_index_from_vectors(spark, sf):
    """Vectors to codes to unique tokens to an index file and back: every item with a SID of its own, and the codes it stands for."""
    _, index = sid_index(vectors(spark, sf), 16, 3)
    path = durable_path(spark, "index")
    writers.write_sid_index(index, path, "item_id", "tokens")
    back = read_json_lines(spark, path, "key string, value array<string>").select(
        F.col("key").cast("bigint").alias("item_id"), F.array_join("value", "").alias("sid"))
    return back.join(index.select("item_id", joined("codes").alias("codes")), "item_id").select("item_id", "codes", "sid")


@query("balanced_kmeans_codes")
def balanced_kmeans_codes(spark, sf):
    """Codes of a fit within the size bounds, its mean squared error, and that of every item at its nearest code instead."""
    v = vectors(spark, sf)
    books, codes = clusters.residual_balanced_kmeans(v, 8, 2)
    return with_errors(codes, books, v, nearest_mse=quantize.encode(v, books))


MAP_ITERS = 6


def uniform_level(level: int) -> list[str]:
    """Temperature, scalings and walk of one level in SQL, on residuals `m{level}`; the codes are `a{level}`."""
    n, tau = level, f"(SELECT tau FROM tau{level})"
    ctes = [f"e{n} AS MATERIALIZED (SELECT vec_id, b.code, sum((x - c) * (x - c)) AS dist FROM m{n} JOIN b{n} b USING (d) GROUP BY 1, 2)",
            f"tau{n} AS MATERIALIZED (SELECT greatest(0.1 * median(q), 1e-6) AS tau FROM (SELECT vec_id, quantile_cont(dist - lo, 0.9) AS q "
            f"FROM (SELECT vec_id, dist, min(dist) OVER (PARTITION BY vec_id) AS lo FROM e{n}) GROUP BY 1))",
            f"ker{n} AS MATERIALIZED (SELECT vec_id, code, dist, exp(-(dist - min(dist) OVER (PARTITION BY vec_id)) / {tau}) AS g FROM e{n})",
            f"v{n}_0 AS (SELECT code, 1.0::DOUBLE AS v FROM cls)"]
    for i in range(MAP_ITERS):
        ctes += [f"u{n}_{i} AS MATERIALIZED (SELECT vec_id, 1 / sum(g * v) AS u FROM ker{n} JOIN v{n}_{i} USING (code) GROUP BY 1)",
                 f"v{n}_{i + 1} AS MATERIALIZED (SELECT code, (max(cap) / max(n)) / (sum(g * u) / max(n)) AS v "
                 f"FROM ker{n} JOIN u{n}_{i} USING (vec_id) JOIN cap USING (code) GROUP BY 1)"]
    return ctes + [
        f"pref{n} AS MATERIALIZED (SELECT vec_id, list(code ORDER BY dist / {tau} - ln(v), code) AS p FROM ker{n} JOIN v{n}_{MAP_ITERS} USING (code) GROUP BY 1)",
        f"turn{n} AS MATERIALIZED (SELECT vec_id, p, row_number() OVER (ORDER BY CAST('0x' || substr(md5(vec_id || '|{42 + n}'), 1, 15) AS BIGINT), vec_id) AS t FROM pref{n})",
        f"""a{n} AS (
    SELECT CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS code, (SELECT list(CAST(cap AS BIGINT) ORDER BY code) FROM cap) AS room
    UNION ALL
    SELECT s.t, s.vec_id, s.c, list_transform(s.room, lambda x, i: CASE WHEN i = s.c + 1 THEN x - 1 ELSE x END) FROM (
      SELECT turn{n}.t, turn{n}.vec_id, a{n}.room, list_filter(turn{n}.p, lambda q: a{n}.room[CAST(q AS INTEGER) + 1] > 0)[1] AS c FROM a{n} JOIN turn{n} ON turn{n}.t = a{n}.t + 1) s)""",
        f"m{n + 1} AS MATERIALIZED (SELECT vec_id, d, x - c AS x FROM m{n} JOIN a{n} USING (vec_id) JOIN b{n} b USING (code, d))"]


@query("uniform_mapping_codes", "WITH RECURSIVE " + ",\n".join([
    *quantizer_ctes(2), *sinkhorn_ctes()[:2], "m0 AS MATERIALIZED (SELECT vec_id, d, x FROM r0)", *uniform_level(0), *uniform_level(1)]) + """
    SELECT vec_id AS item_id, a0.code || ',' || a1.code AS codes FROM a0 JOIN a1 USING (vec_id)""")
def uniform_mapping_codes(spark, sf):
    return balance.uniform_mapping(vectors(spark, sf), class_codebooks(spark, sf, 2), MAP_ITERS).select("item_id", joined("codes").alias("codes"))


@query("collisions_resolved")
def collisions_resolved(spark, sf):
    """Codes of every item before and after the members of shared paths have spread over the last level."""
    v, books = vectors(spark, sf), class_codebooks(spark, sf, 2)
    coded = materialize(quantize.encode(v, books), "codes")
    out = collisions.resolve_collisions(v, coded, books)
    return coded.select("item_id", joined("codes").alias("before")).join(out.select("item_id", joined("codes").alias("codes")), "item_id")


MASK = "4294967295::UBIGINT"


def times32(x: str, factor: int) -> str:
    return f"((({x}) * {factor}::UBIGINT) & {MASK})"


def rotated32(x: str, by: int) -> str:
    return f"(((({x}) << {by}::UBIGINT) | (({x}) >> {32 - by}::UBIGINT)) & {MASK})"


def mixed32(block: str) -> str:
    """Four bytes of a word's hex digits, the first the lowest, as murmur3 mixes them; missing ones are 0."""
    digits = " || ".join(f"substr(x, 8 * ({block}) + {i}, 2)" for i in (7, 5, 3, 1))
    return times32(rotated32(times32(f"CAST('0x0' || {digits} AS UBIGINT)", 0xCC9E2D51), 15), 0x1B873593)


def hashed_words() -> list[str]:
    """Murmur3 of every word in SQL, with the seed and the 64 buckets of Spark ML; rows of texts are `t`, the split texts `s`."""
    ctes = [r"t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, regexp_split_to_array(text, '[\s\x0B]+') AS s FROM documents)",
            "w AS MATERIALIZED (SELECT r, unnest(s) AS word FROM t)",
            "b0 AS (SELECT word, hex(encode(word)) AS x, strlen(word) AS n FROM (SELECT DISTINCT word FROM w))",
            f"b1 AS (SELECT word, n, list_transform(range(n // 4), lambda i: {mixed32('i')}) AS blocks, {mixed32('n // 4')} AS rest FROM b0)",
            "b2 AS (SELECT word, xor(xor(list_reduce(blocks, lambda h, k: "
            f"({times32(rotated32('xor(h, k)', 13), 5)} + 3864292196::UBIGINT) & {MASK}, 42::UBIGINT), rest), n::UBIGINT) AS h FROM b1)"]
    for i, (shift, factor) in enumerate(((16, 0x85EBCA6B), (13, 0xC2B2AE35)), 3):
        ctes.append(f"b{i} AS (SELECT word, {times32(f'xor(h, h >> {shift}::UBIGINT)', factor)} AS h FROM b{i - 1})")
    return [*ctes, "b AS (SELECT word, xor(h, h >> 16::UBIGINT) & 63::UBIGINT AS b FROM b4)"]


@query("text_embeddings", with_sql(
    *hashed_words(), "hits AS (SELECT r, b, count(*) AS n FROM w JOIN b USING (word) GROUP BY 1, 2)",
    "v AS (SELECT r, list(coalesce(n, 0) ORDER BY b) AS v FROM (SELECT r, b FROM t, range(64) k(b)) LEFT JOIN hits USING (r, b) GROUP BY 1)", body="""
    SELECT doc_id, array_to_string(v, ',') AS embedding, CAST(len(v) AS INTEGER) AS dim, CAST(len(s) AS BIGINT) AS words,
           count(DISTINCT v) OVER (PARTITION BY text) = 1 AS alike FROM t JOIN v USING (r)"""))
def text_embeddings(spark, sf):
    """Each text's vector of hashed word counts, its length, the words it counts, and whether texts with the same words have the same vector.

    A missing text has a vector of zeros and no number of words.
    """
    docs = table(spark, sf, "documents").select(F.struct("doc_id", F.md5("text").alias("md5")).alias("doc"), "text")
    made = quantize.embed_texts(docs, "doc", "text").select("doc.*", "embedding")
    kinds = made.groupBy(F.col("md5").alias("same")).agg(F.countDistinct("embedding").alias("kinds"))
    words = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("bigint")
    return made.join(kinds, F.col("md5").eqNullSafe(F.col("same")), "left").select(
        "doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("bigint")), ",").alias("embedding"),
        F.size("embedding").alias("dim"), F.when(F.col("md5").isNotNull(), words).alias("words"), (F.col("kinds") == 1).alias("alike"))
