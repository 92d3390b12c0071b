"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score. DataFrame functions only.

A kind has a pattern, a validator and a score. Matches that fail the validator are dropped. The four base kinds score
high enough by themselves; the further kinds need a checksum or a telling word just before them, and never overlap a base
span. Positions come from the lengths of the matches and of the pieces between them, so one text needs no Python and no
shuffle, whatever its length.

The patterns use possessive quantifiers and start guards. They find exactly what the plain forms in the SQL find, but never
walk a run of characters twice and never recurse, so long runs cost linear time and no stack.

Defined results. Null or empty text: no spans. Repeated rows are handled alike. Empty table: empty result. Other columns
pass through `redact`, whatever their names; `with_spans` adds columns that start with `_p_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import words as W

BASE_KINDS, EXTRA_KINDS = ["email", "ip", "card", "phone"], ["iban", "ssn", "tel", "secret"]
# fixed values: lengths of account numbers by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?:" + "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()) + ")"
KINDS = BASE_KINDS + EXTRA_KINDS
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){13})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": IBAN,
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "tel": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{24,}+",
}
# what a text must contain before its full pattern is tried
HINTS = {
    "email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", "ssn": r"[0-9]-[0-9]{2}-[0-9]{4}", "tel": r"[0-9][.-][0-9]{4}",
    "secret": r"[A-Za-z0-9_+/-]{24}",
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.4, "phone": 0.7, "iban": 0.2, "ssn": 0.3, "tel": 0.3, "secret": 0.3}
CHECKSUM, CONTEXT, ACCEPT, NEAR = 0.5, 0.4, 0.6, 40
CONTEXT_WORDS = {
    "email": "mail|email|contact", "ip": "ip|address|host|server", "card": "card|visa|mastercard|credit",
    "phone": "phone|tel|call|fax|mobile", "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security|social", "tel": "phone|tel|call|fax|mobile|telefon|movil",
    "secret": "token|secret|password|passwd|pwd|credential|bearer|key|apikey",
}
BLOCK = 256


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn check of a digit string: every second digit from the right counts double, less nine above nine."""
    def add(acc, i):
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        y = F.when(i % 2 == 0, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)
        return acc + y
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def mod97(m: Column) -> Column:
    """ISO 7064 check of an account number: country and check digits moved to the end, letters as 10 to 35."""
    c = F.regexp_replace(m, " ", "")
    r = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))

    def add(acc, i):
        code = F.ascii(F.substring(r, i, F.lit(1)))
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), add) == 1


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(plain) <= 3, F.concat(F.lit("0"), plain).cast("int") <= 255).otherwise(F.lit(False))


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(m, r"\."), _small),
        "card": F.when((n >= 13) & (n <= 19), luhn(digits(m))).otherwise(F.lit(False)),
        "phone": (n >= 9) & (n <= 15),
        "iban": mod97(m),
        "ssn": F.lit(True),
        "tel": F.lit(True),
        "secret": m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
    }[kind]


def _running_blocks(xs: Column) -> Column:
    """Running sums inside blocks of `BLOCK` numbers, so that long lists are not copied once per element."""
    def within(b):
        return F.aggregate(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)), F.array().cast("array<bigint>"),
                           lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x)))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), within)


def _join_blocks(blocks: Column) -> Column:
    offsets = F.aggregate(blocks, F.array(F.lit(0).cast("bigint")),
                          lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(b, -1))))
    return F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)),
                                lambda b, o: F.transform(b, lambda x: x + o)))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `_p_spans`: structs (kind, start, end, score) in code points, end exclusive, by kind and start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    nothing, no_steps = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    found = {k: text.rlike(HINTS[k]) for k in KINDS}
    rows = docs.withColumns({f"_p_m_{k}": F.when(found[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(nothing)
                             for k in KINDS})
    some = {k: F.size(f"_p_m_{k}") > 0 for k in KINDS}
    # a match starts after the piece before it, counted from the end of the match before that
    rows = rows.withColumns({f"_p_g_{k}": F.when(some[k], F.transform(F.split(text, PATTERNS[k], -1), F.length)).otherwise(F.array().cast("array<int>"))
                             for k in KINDS})

    def steps(kind):
        pieces, matches = F.col(f"_p_g_{kind}"), F.col(f"_p_m_{kind}")
        return F.transform(matches, lambda m, i: (F.get(pieces, i) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0)).cast("bigint"))

    rows = rows.withColumns({f"_p_s_{k}": F.when(some[k], steps(k)).otherwise(no_steps) for k in KINDS})
    rows = rows.withColumns({f"_p_b_{k}": F.when(some[k], _running_blocks(F.col(f"_p_s_{k}"))) for k in KINDS})
    rows = rows.withColumns({f"_p_at_{k}": F.when(some[k], _join_blocks(F.col(f"_p_b_{k}"))).otherwise(no_steps) for k in KINDS})

    def scored(kind):
        def one(m, start):
            before = F.lower(F.substring(text, F.greatest(start - NEAR, F.lit(0)).cast("int") + 1, F.least(start, F.lit(NEAR)).cast("int")))
            near = before.rlike(rf"(^|[^a-z])({CONTEXT_WORDS[kind]})([^a-z]|$)")
            score = F.lit(PRIOR[kind]) + F.lit(CHECKSUM if kind in ("card", "iban") else 0.0) + F.when(near, CONTEXT).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"),
                            F.round(F.least(score, F.lit(1.0)), 2).alias("score"), valid(kind, m).alias("ok"))
        ok = F.filter(F.zip_with(f"_p_m_{kind}", f"_p_at_{kind}", one), lambda s: s["ok"] & (s["score"] >= ACCEPT))
        return F.when(some[kind], ok).otherwise(F.filter(F.array(F.struct(
            F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"),
            F.lit(0.0).alias("score"), F.lit(True).alias("ok"))), lambda s: F.lit(False)))

    rows = rows.withColumns({f"_p_k_{k}": scored(k) for k in KINDS})
    rows = rows.withColumn("_p_base", F.concat(*[F.col(f"_p_k_{k}") for k in BASE_KINDS]))

    def alone(s):
        """Not part of a longer run of letters and digits, and clear of all base spans."""
        around = F.concat(F.when(s["start"] > 0, F.substring(text, s["start"].cast("int"), F.lit(1))).otherwise(F.lit("")),
                          F.substring(text, s["end"].cast("int") + 1, F.lit(1)))
        return ~around.rlike("[A-Za-z0-9+-]") & ~F.exists("_p_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    extra = F.concat(*[F.col(f"_p_k_{k}") for k in EXTRA_KINDS])
    rows = rows.withColumn("_p_extra", F.when(F.size(extra) > 0, F.filter(extra, alone)).otherwise(extra))
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))
    return (rows.withColumn("_p_spans", F.transform(F.concat("_p_base", "_p_extra"), bare))
            .select(*docs.columns, "_p_spans", F.size("_p_base").alias("_p_n_base")))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by `[kind]`; of overlapping spans the first names the whole stretch."""
    return W.shielded(docs, lambda rows: _redacted(rows, text_col), text_col)


def _redacted(docs: DataFrame, text_col: str) -> DataFrame:
    rows = with_spans(docs, text_col)
    ordered = F.array_sort(F.transform("_p_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text = F.col(text_col)

    def cut(acc, s):
        piece = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        parts = F.when(fresh, F.concat(acc["parts"], F.array(piece, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["parts"])
        return F.struct(parts.alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at"))
    done = F.aggregate(ordered, start, cut, lambda acc: F.concat(
        F.concat_ws("", acc["parts"]), F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return rows.withColumn(text_col, F.when(F.size("_p_spans") > 0, done).otherwise(text)).select(*docs.columns)


def span_list(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_spans(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("_p_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *[count(k) for k in BASE_KINDS],
                       F.sha2(span_list(F.slice("_p_spans", F.lit(1), F.col("_p_n_base"))), 256).alias("base_sha256"),
                       span_list(F.col("_p_spans")).alias("spans"))


QUERIES = {"op8_pii": op8_pii}
# the same kinds by their plain patterns, one row per match
ORACLES = {"op8_pii": r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k(o, kind, pat) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (4, 'iban', '{IBAN}'), (5, 'ssn', '[0-9]{3}-[0-9]{2}-[0-9]{4}'),
  (6, 'tel', '\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}'), (7, 'secret', '[A-Za-z0-9_+/-]{24,}')),
m AS (SELECT doc_id, o, kind, t, regexp_extract_all(t, pat) AS ms, regexp_split_to_array(t, pat) AS gs FROM d, k WHERE regexp_matches(t, pat)),
u AS (SELECT doc_id, o, kind, t, unnest(ms) AS x, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM m),
p AS (SELECT *, CAST(sum(length(g) + length(x)) OVER (PARTITION BY doc_id, o ORDER BY i) AS BIGINT) AS e,
             regexp_replace(x, '[^0-9]', '', 'g') AS ds, replace(x, ' ', '') AS cs FROM u),
q AS (SELECT *, e - length(x) AS s FROM p),
v AS (SELECT *, lower(substring(t, greatest(s - 40, 0) + 1, least(s, 40))) AS near FROM q WHERE CASE o
  WHEN 1 THEN len(list_filter(string_split(x, '.'), lambda z: length(ltrim(z, '0')) > 3 OR coalesce(TRY_CAST(right('000' || ltrim(z, '0'), 3) AS INT), 999) > 255)) = 0
  WHEN 2 THEN length(ds) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(ds) + 1), lambda j:
       CASE WHEN j % 2 = 0 THEN 2 * CAST(ds[length(ds) - j + 1] AS INT) - CASE WHEN ds[length(ds) - j + 1] > '4' THEN 9 ELSE 0 END
            ELSE CAST(ds[length(ds) - j + 1] AS INT) END)) % 10 = 0
  WHEN 3 THEN length(ds) BETWEEN 9 AND 15
  WHEN 4 THEN TRY_CAST(array_to_string(list_transform(string_split(cs[5:] || cs[:4], ''), lambda z:
       CASE WHEN z BETWEEN '0' AND '9' THEN z ELSE CAST(ascii(z) - 55 AS VARCHAR) END), '') AS HUGEINT) % 97 = 1
  WHEN 7 THEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')
  ELSE true END),
b AS (SELECT doc_id, o, kind, s, e FROM v WHERE o < 4),
a AS (SELECT doc_id, o, kind, s, e FROM b UNION ALL
      SELECT doc_id, o, kind, s, e FROM v WHERE o >= 4
        AND (o = 4 OR regexp_matches(near, CASE o WHEN 5 THEN '(^|[^a-z])(ssn|social security|social)([^a-z]|$)'
                                                 WHEN 7 THEN '(^|[^a-z])(token|secret|password|passwd|pwd|credential|bearer|key|apikey)([^a-z]|$)'
                                                 ELSE '(^|[^a-z])(phone|tel|call|fax|mobile|telefon|movil)([^a-z]|$)' END))
        AND NOT regexp_matches(CASE WHEN s > 0 THEN substring(t, s, 1) ELSE '' END || substring(t, e + 1, 1), '[A-Za-z0-9+-]')
        AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = v.doc_id AND b.s < v.e AND v.s < b.e)),
g AS (SELECT doc_id, CAST(count(*) FILTER (o = 0) AS BIGINT) AS n_email, CAST(count(*) FILTER (o = 1) AS BIGINT) AS n_ip,
             CAST(count(*) FILTER (o = 2) AS BIGINT) AS n_card, CAST(count(*) FILTER (o = 3) AS BIGINT) AS n_phone,
             coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < 4), '') AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)""".replace("{IBAN}", IBAN)}
