"""Exact Jaccard self-join of documents on word n-grams, with prefixes of adaptive length.

Shingles are ordered from rare to frequent by counts over all documents. A document with n shingles that needs an overlap of
at least a with any partner looks only at its first n - a + l shingles; two linked documents then share at least the smaller
of their two l among them. Every document picks its own l from 1 to `MAX_EXTRA`: lengthening the prefix scans more list
entries but leaves fewer candidates to verify. The lengths of the lists estimate both costs, and the cheapest l is taken.
Verification counts the whole sets.

Steps: documents with equal sets form a class. Each class first meets the leader of the list it shares most entries with;
verified pairs join into components. The exact pass then pairs classes of different components only: within a list, members
of its largest component are not paired with each other. So a group of n near copies costs about n pairs, and no link
between components is lost.

The counts that order shingles live in a table of 2**`sketch_bits` cells, whatever the input; crowded cells only make the
order less sharp, never the result wrong.

Defined results. Null text or text without words: no shingles, linked with nothing. Fewer words than the width: the whole
sequence is one shingle. Repeated rows and ids: rows are judged by their text; null ids are never a component's id unless
all of it are null. Empty table: empty result. Other columns pass through `keep_first`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqloom.llm import words as W
from seqloom.llm.components import connected_components, discard, stored

WIDTH, PERCENT = 3, 90
SKETCH_BITS, MAX_EXTRA = 19, 16
BROADCAST_BYTES = 32 << 20
SCAN_COST, VERIFY_COST, ROW_COST = 1.0, 20.0, 2.0


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every document of a chunk, sorted by document and hash, and their offsets."""
    data = W.LOWER[data]
    starts, ends, per_doc = W.spans(~W.SPACE[data], offsets)
    words, docs = W.span_hashes(data, starts, ends), W.owners(per_doc)
    hashes = W.window_hashes(words, width)
    whole = docs[:len(hashes)] == docs[width - 1:] if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[whole], docs[:len(whole)][whole]
    n_words = np.diff(per_doc)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        one = np.array([W.mix(W.window_hashes(words[per_doc[d]:per_doc[d + 1]], int(n_words[d])) + np.uint64(n_words[d]))[0] for d in short],
                       np.uint64)
        hashes, owner = np.concatenate([hashes, one]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def set_keys(hashes: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set, None for the empty one."""
    out = []
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(W.mix(hashes ^ np.uint64(salt)), out=total[1:])
        sums.append(total[at[1:]] - total[at[:-1]])
    both = np.stack([W.mix(sums[0]), sums[1]], axis=1).astype(">u8")
    for i, n in enumerate(np.diff(at)):
        out.append(both[i].tobytes() if n else None)
    return out


def shingle_counts(docs: DataFrame, text_col: str, width: int, bits: int) -> np.ndarray:
    """In how many documents each cell's shingles occur, over all documents; one number per cell reaches the driver."""
    cells = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, _, data, offsets in W.text_chunks(batch.column(0)):
                hashes, _ = shingle_sets(data, offsets, width)
                total += np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])

    rows = W.map_arrow(docs.select(text_col), count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def min_overlap(n, percent: int):
    """Least overlap of a set of n with any set it may link with."""
    return (percent * n + 99) // 100


def longest_prefixes(hashes: np.ndarray, at: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each set from rare to frequent, and how many of them its longest prefix has."""
    cell = counts[(hashes & np.uint64(len(counts) - 1)).astype(np.int64)]
    n = np.diff(at)
    need = min_overlap(n, percent)
    return hashes[np.lexsort((hashes, cell, W.owners(at)))], n - need + np.minimum(need, MAX_EXTRA)


def prefixes(docs: DataFrame, id_col: str, text_col: str, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(id, n, key, prefix) of every document; the key names its set, null when empty, the prefix is the longest allowed."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int64))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
                           T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ids = W.arrow_column(batch, id_col)
            for lo, hi, data, offsets in W.text_chunks(W.arrow_column(batch, text_col)):
                hashes, at = shingle_sets(data, offsets, width)
                keys = set_keys(hashes, at)
                ordered, size = longest_prefixes(hashes, at, table, percent)
                stops = np.append(0, np.cumsum(size))
                take = np.repeat(at[:-1] - stops[:-1], size) + np.arange(stops[-1])
                prefix = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ordered[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(keys, pa.binary()), prefix],
                    names=[f.name for f in schema])

    return W.map_arrow(docs.select(id_col, text_col), run, schema)


def keyed_texts(docs: DataFrame, text_col: str, width: int, keep: list[str]) -> DataFrame:
    """`docs` with columns `keep` and the name of each text's shingle set as `_j_key`."""
    fields = [f for f in docs.schema if f.name in keep]
    schema = T.StructType([*fields, T.StructField("_j_key", T.BinaryType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for _, _, data, offsets in W.text_chunks(W.arrow_column(batch, text_col)):
                keys += set_keys(*shingle_sets(data, offsets, width))
            yield pa.RecordBatch.from_arrays([W.arrow_column(batch, c) for c in names] + [pa.array(keys, pa.binary())], names=[*names, "_j_key"])

    return W.map_arrow(docs.select(*names), run, schema)


def small(side: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """`side` for a broadcast join if its counted size allows; otherwise as it is, for a shuffled join."""
    return F.broadcast(side) if n_rows * row_bytes <= BROADCAST_BYTES else side


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole shingle sets reach the threshold."""
    pairs, pairs_path = stored(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes, "node")
    wanted, wanted_path = stored(wanted, "wanted")
    # a row is an id, a node and a key of 16 bytes, with room for ids that are short strings
    wanted = small(wanted, wanted.count(), 200)
    texts = keyed_texts(docs.select(F.col(id_col).alias("_j_id"), F.col(text_col).alias("_j_text")), "_j_text", width, ["_j_id", "_j_text"])
    # the class's own document, by set and id, so that copies are left behind
    texts = (texts.join(wanted, (F.col("_j_key") == F.col("key")) & F.col("_j_id").eqNullSafe(F.col("rep")))
             .select("node", F.col("_j_text").alias("text")).dropDuplicates(["node"]))
    texts, texts_path = stored(texts, "texts")
    rows = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (W.arrow_column(batch, c).cast(pa.large_binary()) for c in ("text_a", "text_b"))
            sizes = np.cumsum([a + b for a, b in zip(pc.binary_length(left).to_pylist(), pc.binary_length(right).to_pylist(), strict=True)])
            lo = 0
            while lo < batch.num_rows:  # pairs whose texts are a chunk together, one pair at least
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + W.CHUNK_BYTES, "right")))
                part = batch.slice(lo, hi - lo)
                hashes, owner = [], []
                for side in (left, right):
                    for first, _, data, offsets in W.text_chunks(side.slice(lo, hi - lo)):
                        found, at = shingle_sets(data, offsets, width)
                        hashes.append(found)
                        owner.append(first + W.owners(at))
                hashes, owner = np.concatenate(hashes), np.concatenate(owner)
                order = np.lexsort((hashes, owner))
                same = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
                inter = np.bincount(owner[order[1:]][same], minlength=part.num_rows)
                of_pair = np.bincount(owner, minlength=part.num_rows)
                yield part.select(["a", "b"]).filter(pa.array(100 * inter >= percent * (of_pair - inter)))
                lo = hi

    out, _ = stored(W.map_arrow(rows, check, "a bigint, b bigint"), "links")
    for path in (pairs_path, wanted_path, texts_path):
        discard(docs.sparkSession, path)
    return out


def adapted(entries: DataFrame, percent: int) -> DataFrame:
    """The list entries (token, node, n, pos, c) within the prefix each class chooses, with its extra length `extra`.

    `hub` counts the entries a class shares with others in its longest prefix: where a group of copies has an original, that
    shares the most, as it has no words of its own.
    """
    need = F.floor((percent * F.col("n") + 99) / 100).cast("int")
    lengths = range(1, MAX_EXTRA + 1)
    # entries of lists that no other class is on were dropped before; they cost nothing
    scans = entries.groupBy("node", "n").agg(F.count(F.lit(1)).alias("hub"), *[F.sum(F.when(F.col("pos") < F.col("n") - need + k, F.col("c") - 1).otherwise(0)).alias(f"s{k}")
                                               for k in lengths])
    costs = [F.struct(F.when(k <= need, SCAN_COST * F.col(f"s{k}") + VERIFY_COST * F.col(f"s{k}") / k + ROW_COST * k)
                      .otherwise(F.lit(float("inf"))).alias("cost"), F.lit(k).alias("k")) for k in lengths]
    chosen = scans.select("node", "hub", F.array_min(F.array(*costs))["k"].alias("extra"))
    # how many entries before this one could match anything; matches of two prefixes always lie in both
    before = Window.partitionBy("node").orderBy("pos")
    return (entries.join(chosen, "node").withColumn("live", F.row_number().over(before) - 1)
            .where(F.col("pos") < F.col("n") - need + F.col("extra")).drop("c"))


def _leader_pairs(entries: DataFrame) -> DataFrame:
    """For every class the leader of the lists it shares most entries with; a list's leader is its class of largest `hub`."""
    leads = entries.groupBy("token").agg(F.max(F.struct("hub", -F.col("node"))).alias("best")).select(
        "token", (-F.col("best.col2")).alias("lead"))
    shared = (entries.join(leads, "token").where("node <> lead").groupBy("node", "lead", "extra").agg(F.count(F.lit(1)).alias("c"))
              .where("c >= extra"))
    best = shared.groupBy("node").agg(F.max("c").alias("c"))
    # among equals the smallest leader; all these aggregates combine before they shuffle
    return (shared.join(best, ["node", "c"]).groupBy("node").agg(F.min("lead").alias("lead"))
            .select(F.col("lead").alias("a"), F.col("node").alias("b")))


def _cross_pairs(entries: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share enough prefix entries."""
    rows = entries.join(parts, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component", "hub")
    rows, rows_path = stored(rows, "entries")
    # linked classes share an entry already in their shortest prefixes; lists of those are enough to find the pairs
    heads = rows.where(F.col("pos") <= F.col("n") - F.floor((percent * F.col("n") + 99) / 100))
    sizes = heads.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    # the largest component of each list, named by count and then by number
    lists = (sizes.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max("c").alias("top")).where("comps > 1"))
    main = sizes.join(lists, "token").where("c = top").groupBy("token").agg(F.max("comp").alias("main"))
    live, live_path = stored(heads.join(main, "token"), "live")
    x, y = live.where("comp <> main").alias("x"), live.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    need = F.ceil(percent * (nx + ny) / (100 + percent))
    # what two sets can share at most, given where a common entry stands in each and how many before it could match
    most = F.least("x.live", "y.live") + 1 + F.least(nx - 1 - F.col("x.pos"), ny - 1 - F.col("y.pos"))
    near = ((F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp"))
            & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
            & (100 * nx >= percent * ny) & (100 * ny >= percent * nx) & (most >= need))
    met = x.join(y, near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    met, met_path = stored(met, "met")
    # the whole prefixes of both, which a document's length bounds
    ends = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    sides, sides_path = stored(rows.join(ends, "node").groupBy("node", "n", "extra").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("es")), "sides")

    def side(end: str) -> DataFrame:
        return sides.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "extra", "es")])

    both = met.join(side("a"), "a").join(side("b"), "b")
    both = both.withColumn("common", F.array_intersect(F.col("es_a.token"), F.col("es_b.token")))
    last = F.try_element_at("common", F.lit(-1))

    def place(end: str):
        return F.get(F.col(f"es_{end}"), (F.array_position(F.col(f"es_{end}.token"), last) - 1).cast("int"))["pos"]

    # after the last common entry of the prefixes, the shorter of the two rests limits what can still be shared
    rest = F.least(F.col("n_a") - 1 - place("a"), F.col("n_b") - 1 - place("b"))
    enough = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    pairs, _ = stored(both.where((F.size("common") >= F.least("extra_a", "extra_b")) & (F.size("common") + rest >= enough)).select("a", "b"), "cross")
    for path in (rows_path, live_path, met_path, sides_path):
        discard(entries.sparkSession, path)
    return pairs


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
                 sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """Per document (id, n, key) and per set (key, rep, component_id, first), the component named by its smallest id.

    One set of each component is `first`: by its smallest id, null ids last, then by key.
    """
    spark = docs.sparkSession
    counts = shingle_counts(docs, text_col, width, sketch_bits)
    raw, raw_path = stored(prefixes(docs, id_col, text_col, counts, width, percent), "prefixes")
    found, _ = stored(raw.select("id", "n", "key"), "sets")
    wide = raw.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    wide, wide_path = stored(wide.withColumn("node", F.monotonically_increasing_id()), "classes")
    discard(spark, raw_path)
    classes, _ = stored(wide.select("node", "key", "rep"), "classes")
    entries = wide.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    entries, entries_path = stored(entries.join(lists, "token"), "entries")
    discard(spark, wide_path)
    entries, _ = stored(adapted(entries, percent), "adapted")
    discard(spark, entries_path)
    args = (classes, docs, id_col, text_col, width, percent)
    links = verified(_leader_pairs(entries), *args)
    more = verified(_cross_pairs(entries, connected_components(links), percent), *args)
    parts = connected_components(links.union(more))
    named = classes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).select("key", "rep", "component")
    least = F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "key"))
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"), least.alias("least"))
    sets = named.join(names, "component").select("key", "rep", "component_id", (F.col("key") == F.col("least.key")).alias("first"))
    return found.select("id", "n", "key"), sets


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    found, sets = ngram_groups(docs, id_col, text_col, **options)
    return (found.join(sets.select("key", "component_id"), "key", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """`docs` with one document of each component, that with the smallest id (null ids last); documents without words stay."""
    return W.shielded(docs, lambda rows: _first_of_groups(rows, id_col, text_col, width, **options), id_col, text_col)


def _first_of_groups(docs: DataFrame, id_col: str, text_col: str, width: int, **options) -> DataFrame:
    _, sets = ngram_groups(docs, id_col, text_col, width, **options)
    chosen = sets.where("first").select(F.col("key").alias("_j_k"), F.col("rep").alias("_j_rep"))
    chosen, _ = stored(chosen, "chosen")
    rows = keyed_texts(docs, text_col, width, docs.columns)
    kept = rows.join(chosen, (F.col("_j_key") == F.col("_j_k")) & F.col(id_col).eqNullSafe(F.col("_j_rep"))).dropDuplicates(["_j_key"])
    return kept.select(*docs.columns).unionByName(rows.where("_j_key IS NULL").select(*docs.columns))


def op2_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return join_documents(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op2_ngram_join": op2_ngram_join}
# all pairs that share a shingle; at the size of the check tables it runs in seconds
ORACLES = {"op2_ngram_join": r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, n, unnest(g) AS t FROM s JOIN n USING (doc_id)),
p AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
                    FROM e x JOIN e y ON x.t = y.t AND x.doc_id < y.doc_id AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n
                    GROUP BY 1, 2) WHERE 100 * c >= 90 * (na + nb - c)),
u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = n.doc_id"""}
