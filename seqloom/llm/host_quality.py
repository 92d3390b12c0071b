"""Quality rules with host-level verdicts.

Every document is measured and checked against rules. The base rules reject a document on their own. The other rules
count by host (here: the `source` column): failures per host and rule are shrunk towards the corpus rate with a beta
prior whose strength is fitted to the spread between hosts, and a host whose shrunk rate stays above `max_rate` is
judged against that rule. Documents of such a host that break the rule are rejected; its other documents stay.

Defined results. Null or empty text: no words, rejected by the base rules. Null host: a document without host, judged by
the base rules only. Repeated rows are judged alike. Empty table: empty result. A clashing column name in the input is
carried through; internal columns start with `_q_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import words as W
from seqloom.session import materialize

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 8
MAX_RATE = 0.2
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray, all_of_them: bool) -> np.ndarray:
    """Flags of keys seen more than once: every occurrence, or all but the first of each."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    flags = np.zeros(len(keys), bool)
    flags[order[1:]] |= same
    if all_of_them:
        flags[order[:-1]] |= same
    return flags


def measure_chunk(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The measures of each document of a chunk, in the order of `MEASURES`."""
    inside = ~W.SPACE[data]
    starts, ends, per_doc = W.spans(inside, offsets)
    n_words = np.diff(per_doc)
    chars = W.counts_between(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = W.counts_between(SYMBOLS[data], offsets)
    # lines are runs without \n; one that has a word counts as repeated after its first occurrence
    l_starts, l_ends, l_doc = W.spans(data != 0x0A, offsets)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=seen[1:])
    lines = W.keep_by_doc(W.span_hashes(data, l_starts, l_ends), W.owners(l_doc))
    with_word = seen[l_ends] > seen[l_starts]
    again = np.zeros(len(lines), bool)
    again[with_word] = repeated(lines[with_word], False)
    dup_lines = W.counts_between(again, l_doc)
    # a window of words may not reach into the next document
    docs = W.owners(per_doc)
    windows = W.window_hashes(W.span_hashes(data, starts, ends), WINDOW)
    whole = docs[:len(windows)] == docs[WINDOW - 1:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    hits = at[repeated(W.keep_by_doc(windows[at], docs[at]), True)]
    cover = np.zeros(len(docs) + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.subtract.at(cover, hits + WINDOW, 1)
    repeats = W.counts_between(np.cumsum(cover)[:-1] > 0, per_doc)
    return [n_words, chars, symbols, dup_lines, repeats]


def with_measures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or only its columns `keep`) with the measures as `_q_` columns of type long."""
    kept = [f for f in docs.schema if keep is None or f.name in keep]
    schema = T.StructType(kept + [T.StructField(f"_q_{m}", T.LongType()) for m in MEASURES])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure_chunk(data, offsets) for _, _, data, offsets in W.text_chunks(W.arrow_column(batch, text_col))]
            figures = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays(
                [W.arrow_column(batch, n) for n in names] + [pa.array(x.astype(np.int64)) for x in figures],
                names=names + [f"_q_{m}" for m in MEASURES])

    return W.map_arrow(docs.select(*dict.fromkeys([*names, text_col])), run, schema)


def base_failed() -> Column:
    return (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words"))


def host_rules() -> dict[str, Column]:
    """Rules that act through the host: more than a symbol per five words, several repeated lines, odd word lengths."""
    n = F.col("_q_n_words")
    return {
        "symbols": 5 * F.col("_q_n_symbols") > n,
        "lines": F.col("_q_n_dup_lines") >= 3,
        "lengths": (F.col("_q_word_chars") < 3 * n) | (F.col("_q_word_chars") > 12 * n),
    }


def prior_strength(n_hosts: int, n: float, n2: float, failed: float, spread: float) -> float:
    """Strength of the beta prior by moments: the spread of host rates beyond what chance explains.

    `n2` is the sum of squared host sizes, `spread` the sum of failures squared over size.
    """
    rate = failed / n if n else 0.0
    chance = rate * (1 - rate)
    free = n - (n2 / n if n else 0.0) - (n_hosts - 1)
    if chance <= 0 or free <= 0:
        return 1e6
    share = (spread - failed * rate - chance * (n_hosts - 1)) / (chance * free)
    share = round(min(max(share, 1e-6), 1.0), 9)
    return (1 - share) / share


def judge_hosts(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """One row per host (`_q_host`) with a flag `_q_bad_<rule>`: its shrunk failure rate is above `max_rate`.

    Only one row of corpus-wide sums reaches the driver.
    """
    rules = host_rules()
    measured = with_measures(docs.where(F.col(host_col).isNotNull()), text_col, [host_col])
    hosts = materialize(
        measured.groupBy(F.col(host_col).alias("_q_host"))
        .agg(F.count(F.lit(1)).alias("_q_n"), *[F.count_if(rule).alias(f"_q_f_{name}") for name, rule in rules.items()]), "hosts")
    n = F.col("_q_n").cast("double")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"),
        *[F.sum(f"_q_f_{r}").alias(f"f_{r}") for r in rules],
        *[F.sum(F.col(f"_q_f_{r}") * F.col(f"_q_f_{r}") / n).alias(f"s_{r}") for r in rules]).first()
    out = [F.col("_q_host")]
    for r in rules:
        failed = float(sums[f"f_{r}"] or 0)
        strength = prior_strength(sums["k"], sums["n"] or 0.0, sums["n2"] or 0.0, failed, sums[f"s_{r}"] or 0.0)
        prior = strength * (failed / sums["n"]) if sums["n"] else 0.0
        out.append(((F.col(f"_q_f_{r}") + F.lit(prior)) / (F.col("_q_n") + F.lit(strength)) > max_rate).alias(f"_q_bad_{r}"))
    # hosts with no bad mark decide nothing, so only the others are joined
    return hosts.select(*out).where(" OR ".join(f"_q_bad_{r}" for r in rules))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: list[str] | None = None,
          max_rate: float = MAX_RATE) -> DataFrame:
    """`docs` with measures, `_q_base_failed` and `_q_kept`. Reads `docs` twice, for the hosts and for the verdicts."""
    hosts = materialize(judge_hosts(docs, host_col, text_col, max_rate), "bad-hosts")
    measured = with_measures(docs, text_col, keep)
    rows = measured.join(hosts, F.col(host_col) == F.col("_q_host"), "left")
    struck = F.lit(False)
    for name, rule in host_rules().items():
        struck = struck | (F.coalesce(F.col(f"_q_bad_{name}"), F.lit(False)) & rule)
    return (rows.withColumn("_q_base_failed", base_failed()).withColumn("_q_kept", ~F.col("_q_base_failed") & ~struck)
            .drop("_q_host", *[f"_q_bad_{r}" for r in host_rules()]))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    used = [options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("host_col", "source"))]
    return W.shielded(docs, lambda rows: judge(rows, **options).where("_q_kept").select(*rows.columns), *used)


def op6_host_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    rows = judge(docs, keep=["doc_id", "source"])
    return rows.select("doc_id", *[F.col(f"_q_{m}").alias(m) for m in MEASURES],
                       F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


QUERIES = {"op6_host_quality": op6_host_quality}
ORACLES = {"op6_host_quality": r"""
WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
y AS (SELECT doc_id, i, CASE WHEN count(*) OVER r = 8 THEN string_agg(word, ' ') OVER r END AS win FROM x
      WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
z AS (SELECT doc_id, i, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS hit FROM y),
c AS (SELECT doc_id, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM z),
r AS (SELECT doc_id, CAST(sum(covered) AS BIGINT) AS n_repeat_words FROM c GROUP BY doc_id),
m AS MATERIALIZED (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda q: regexp_matches(q, '[^\x20\x09-\x0D]')) AS l FROM d) d
  LEFT JOIN r USING (doc_id)),
f AS MATERIALIZED (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 5 * n_symbols > n_words AS f0, n_dup_lines >= 3 AS f1,
         word_chars < 3 * n_words OR word_chars > 12 * n_words AS f2 FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, unnest([0, 1, 2]) AS rule,
             unnest([sum(f0::INT), sum(f1::INT), sum(f2::INT)])::DOUBLE AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
g AS (SELECT *, count(*) OVER p AS k, sum(n) OVER p AS tn, sum(n * n) OVER p AS n2, sum(bad) OVER p AS tf,
             sum(bad * bad / n) OVER p AS sp FROM h WINDOW p AS (PARTITION BY rule)),
e AS (SELECT *, tf / tn AS rate, (tf / tn) * (1 - tf / tn) AS chance, tn - n2 / tn - (k - 1) AS free FROM g),
a AS (SELECT *, CASE WHEN chance <= 0 OR free <= 0 THEN 1e6 ELSE
         1 / round(least(greatest((sp - tf * rate - chance * (k - 1)) / (chance * free), 1e-6), 1), 9) - 1 END AS strength FROM e),
v AS (SELECT source, max(CASE WHEN rule = 0 THEN bad_host END) AS b0, max(CASE WHEN rule = 1 THEN bad_host END) AS b1,
             max(CASE WHEN rule = 2 THEN bad_host END) AS b2
      FROM (SELECT source, rule, ((bad + strength * rate) / (n + strength) > 0.2)::INT AS bad_host FROM a) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (f0 AND coalesce(b0, 0) = 1 OR f1 AND coalesce(b1, 0) = 1 OR f2 AND coalesce(b2, 0) = 1) AS kept
FROM f LEFT JOIN v USING (source)"""}
