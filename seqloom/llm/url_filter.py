"""URL filter: host and path rules first, then a weighted vocabulary counted by one Aho-Corasick pass.

Rules name a host (with its subdomains) and a path prefix; the longest fitting rule decides. Urls without a rule are judged
by their words: one strict term, or at least `min_soft` different soft terms, block. A term counts only where no letter or
digit stands right before or after it.

Defined results. Null url or one without `://`: empty host and path, no rule, judged by whatever text it has (null: allow).
Repeated rows are judged alike. Empty table: empty result. Other columns pass through; internal columns start with `_u_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
STRICT = ["adult", "porn", "xxx", "sex", "nude", "escort", "casino", "gambling", "jackpot", "viagra", "cialis", "pills", "warez",
          "keygen", "malware", "phishing", "spam"]
SOFT = ["ads", "adserver", "track", "tracker", "click", "free", "cheap", "win", "winner", "bonus", "bet", "bets", "deal", "deals",
        "promo", "loan", "loans", "farm", "crack", "torrent", "download", "hot", "dating", "coupon", "prize"]
MIN_SOFT = 2


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_path(urls: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url))).otherwise(F.lit(""))
    return (urls.withColumn("_u_host", lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)))
            .withColumn("_u_path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Rules are a short list of settings."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(ordered):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Vocabulary:
    """Strict and soft terms in one automaton, built once per Python worker."""

    def __init__(self, strict: list[str], soft: list[str]):
        self.terms = {**dict.fromkeys(soft, False), **dict.fromkeys(strict, True)}
        self._automaton = None

    def __getstate__(self):
        return {"terms": self.terms, "_automaton": None}

    def count(self, text: str) -> tuple[int, int]:
        """Different strict and soft terms of a lower-case text, each with its boundaries."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term, strict in self.terms.items():
                self._automaton.add_word(term, (term, strict))
            self._automaton.make_automaton()
        hits = set()
        for last, (term, strict) in self._automaton.iter(text):
            before, after = text[last - len(term):last - len(term) + 1] if last >= len(term) else "", text[last + 1:last + 2]
            if not _alnum(before) and not _alnum(after):
                hits.add((term, strict))
        n_strict = sum(strict for _, strict in hits)
        return n_strict, len(hits) - n_strict


def _alnum(c: str) -> bool:
    return "0" <= c <= "9" or "a" <= c <= "z"


_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filter_urls(urls: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] = RULES, strict: list[str] = STRICT,
                soft: list[str] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """`urls` with `_u_host`, `_u_path`, `_u_rule`, `_u_strict`, `_u_soft` and `_u_verdict`."""
    vocabulary = Vocabulary(strict, soft)

    @F.pandas_udf("struct<strict:bigint,soft:bigint>")
    def terms(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([vocabulary.count(u.translate(_TO_LOWER)) for u in part.fillna("")], columns=["strict", "soft"])

    rows = with_host_path(urls, url_col).withColumn("_u_terms", terms(F.col(url_col)))
    rows = rows.withColumn("_u_fit", longest_rule(F.col("_u_host"), F.col("_u_path"), rules))
    bad = (F.col("_u_terms.strict") > 0) | (F.col("_u_terms.soft") >= min_soft)
    return (rows.withColumn("_u_rule", F.col("_u_fit.rule")).withColumn("_u_strict", F.col("_u_terms.strict"))
            .withColumn("_u_soft", F.col("_u_terms.soft"))
            .withColumn("_u_verdict", F.coalesce("_u_fit.verdict", F.when(bad, "block").otherwise("allow")))
            .drop("_u_terms", "_u_fit"))


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = filter_urls(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"))
    return rows.select("page_id", F.col("_u_host").alias("host"), F.col("_u_path").alias("path"), F.col("_u_rule").alias("rule"),
                       F.col("_u_verdict").alias("verdict"), F.col("_u_strict").alias("n_strict"), F.col("_u_soft").alias("n_soft"))


def _term_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return (f"CAST(len(list_filter([{listed}], lambda t: regexp_matches(u, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])'))) AS BIGINT)")


def _rule_sql() -> str:
    rows = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)
    return f"rules(rule, h, p, v) AS (VALUES {rows})"


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": f"""
WITH {_rule_sql()},
u AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
             CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM s JOIN rules
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
t AS (SELECT *, {_term_sql(STRICT)} AS n_strict, {_term_sql(SOFT)} AS n_soft FROM s)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN n_strict > 0 OR n_soft >= {MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft FROM t LEFT JOIN f USING (page_id)"""}
