"""Maximal periodic runs of words, and texts without their repetitions.

A run of period q holds at least two periods, so at a scale of blocks of B words with 2 B <= q < 4 B it holds an aligned block
together with its copy q words later. For every scale, B doubling, each block is laid over the window of the distances of that
scale: the sums of squared differences of the words' residues come from a number-theoretic transform modulo a prime, for all
distances at once, and are zero wherever the block occurs. Blocks with a word that does not come back within the window cannot
occur in it and are passed over. Neighbouring blocks with the same distance form a chain; its ends are extended word by word
(fewer than B words, as the next block does not match), by bisection over prefix hashes. What reaches two periods and the least
length is a run; of equal stretches the one of the smallest distance gives the period.

Transforms work modulo a prime and words are compared by hashes on the way, which can only report too much. Every run is
compared byte by byte at the end, and a text with a false one is done again by direct comparison, so the result is exact.

The words of a text stay in one task, as a period may span half of it: about a hundred bytes a word for one text beyond a
megabyte, shorter ones go in chunks of that size. Transforms work in slabs of `SLAB` numbers. Time grows with n log(n) blocks at
worst, whatever the repetitions.

Defined results. Null or empty texts and texts without words: no runs, the empty text. Repeated rows and ids: every row is
searched. Null ids stay null. Empty table: no rows. Other columns are not part of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import words as W

LEAST, FIRST_BLOCK, LARGEST_BLOCK, SLAB, PIECE_WORDS = 12, 2, 1 << 16, 1 << 17, 1 << 16
PRIME, GENERATOR, DIRECT = 7 * (1 << 20) + 1, 3, 64  # products of 64 residues add up exactly in 53 bits
HASH_PRIME, HASH_BASE = (1 << 31) - 1, 1_103_515_245
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def reduced(x: np.ndarray) -> np.ndarray:
    """Residues of exact integers below 2**53, up to one times the prime."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    return x


def _powers(root: int, n: int, prime: int = PRIME) -> np.ndarray:
    out = np.ones(n, np.int64)
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled:filled + more] = out[:more] * pow(root, filled, prime) % prime
        filled += more
    return out


def _root(size: int, inverse: bool) -> int:
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    return pow(root, PRIME - 2, PRIME) if inverse else root


@lru_cache(maxsize=64)
def _matrix(size: int, inverse: bool) -> np.ndarray:
    i = np.arange(size)
    return _powers(_root(size, inverse), size)[np.outer(i, i) % size].astype(np.float64)


@lru_cache(maxsize=64)
def _twiddles(a: int, b: int, inverse: bool) -> np.ndarray:
    i, j = np.arange(a), np.arange(b)
    return _powers(_root(a * b, inverse), a * b)[np.outer(i, j)].astype(np.float64)


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row of residues, without the factor of the inverse; its sizes are powers of two."""
    m, size = x.shape
    if size <= DIRECT:
        return reduced(x @ _matrix(size, inverse))
    bits = size.bit_length() - 1
    a = min(DIRECT, 1 << -(-bits // 2))
    b = size // a
    y = reduced(np.matmul(_matrix(a, inverse), x.reshape(m, a, b)))
    y = reduced(y * _twiddles(a, b, inverse))
    y = transform(np.ascontiguousarray(y).reshape(m * a, b), inverse).reshape(m, a, b)
    return np.ascontiguousarray(y.transpose(0, 2, 1)).reshape(m, size)


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of each block with every stretch of its window; zero where they agree."""
    m, width = blocks.shape
    length = windows.shape[1]
    size = 1 << (length - 1).bit_length()
    g, f = np.zeros((m, size)), np.zeros((m, size))
    f[:, :length] = windows
    g[:, 0] = blocks[:, 0]
    g[:, size - width + 1:] = blocks[:, :0:-1]
    product = transform(reduced(transform(f) * transform(g)), inverse=True)[:, :length - width + 1]
    product = product.astype(np.int64) * pow(size, PRIME - 2, PRIME) % PRIME
    squares = np.zeros((m, length + 1), np.int64)
    np.cumsum((windows.astype(np.int64) ** 2) % PRIME, axis=1, out=squares[:, 1:])
    own = (blocks.astype(np.int64) ** 2 % PRIME).sum(axis=1)
    return (own[:, None] + squares[:, width:] - squares[:, :-width] - 2 * product) % PRIME


class Words:
    """Hashes of the words of some texts, and the prefix hashes that extend matches."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray):
        self.hashes, self.at = hashes, at
        self.docs = W.owners(at)
        self.begin, self.end = at[:-1][self.docs], at[1:][self.docs]
        self.residues = (W.mix(hashes) % np.uint64(PRIME)).astype(np.float64)
        self.sums = None

    def next_same(self) -> np.ndarray:
        """Distance from each word to its next occurrence in the text."""
        keys = W.keep_by_doc(self.hashes, self.docs)
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        out = np.full(len(keys), 1 << 60, np.int64)
        out[order[:-1][same]] = (order[1:] - order[:-1])[same]
        return out

    def agree(self, x: np.ndarray, d: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words from x and from x + d have equal prefix hashes."""
        if self.sums is None:
            self.powers = _powers(HASH_BASE, len(self.hashes) + 1, HASH_PRIME)
            terms = (W.mix(self.hashes) >> np.uint64(33)).astype(np.int64) % HASH_PRIME * self.powers[:-1] % HASH_PRIME
            self.sums = np.append(0, np.cumsum(terms)) % HASH_PRIME
        near = (self.sums[x + length] - self.sums[x]) % HASH_PRIME * self.powers[d] % HASH_PRIME
        return near == (self.sums[x + d + length] - self.sums[x + d]) % HASH_PRIME

    def reach(self, edge: np.ndarray, d: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How many words after (or before) `edge` agree with those d later, at most `limit`."""
        lo, hi = np.zeros_like(limit), limit + 1
        while True:
            open_ = hi - lo > 1
            if not open_.any():
                return lo
            middle = (lo + hi) // 2
            start = edge - middle if back else edge
            fits = self.agree(np.where(open_, start, edge), d, np.where(open_, middle, 0))
            lo = np.where(open_ & fits, middle, lo)
            hi = np.where(open_ & ~fits, middle, hi)


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block size, first distance, number of distances) until no text holds two periods."""
    block, first, count = FIRST_BLOCK, 1, 4 * FIRST_BLOCK - 1
    while 2 * first <= longest:
        size = min(block, LARGEST_BLOCK)
        for lo in range(first, first + count, max(2 * size, 4 * FIRST_BLOCK)):
            yield size, lo, min(max(2 * size, 4 * FIRST_BLOCK), first + count - lo)
        block, first, count = 2 * block, 4 * block, 4 * block


def occurrences(w: Words, starts: np.ndarray, size: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of all zero-mismatch occurrences of blocks at the given distances."""
    length = count + size - 1
    step = max(1, SLAB >> (length - 1).bit_length())
    found_starts, found_distances = [], []
    for lo in range(0, len(starts), step):
        some = starts[lo:lo + step]
        blocks = w.residues[some[:, None] + np.arange(size)]
        windows = w.residues[np.minimum(some[:, None] + first + np.arange(length), len(w.residues) - 1)]
        zero = squared_differences(blocks, windows) == 0
        zero &= np.arange(first, first + count) <= (w.end[some] - size - some)[:, None]
        i, t = np.nonzero(zero)
        found_starts.append(some[i])
        found_distances.append(first + t)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_starts]), np.concatenate([none, *found_distances])


def extended(w: Words, starts: np.ndarray, distances: np.ndarray, size: int) -> np.ndarray:
    """(start, end, period) of the chains of matching blocks that reach two periods."""
    order = np.lexsort((starts, distances))
    s, d = starts[order], distances[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] - s[:-1] != size) | (w.docs[s[1:]] != w.docs[s[:-1]])
    head = np.flatnonzero(new)
    lo, hi, d = s[head], s[np.append(head[1:], len(s)) - 1] + size, d[head]
    long = hi - lo + 2 * (size - 1) + d >= np.maximum(LEAST, 2 * d)
    lo, hi, d = lo[long], hi[long], d[long]
    left = w.reach(lo, d, np.minimum(size - 1, lo - w.begin[lo]), True)
    right = w.reach(hi, d, np.minimum(size - 1, w.end[lo] - hi - d), False)
    lo, hi = lo - left, hi + right + d
    keep = hi - lo >= np.maximum(LEAST, 2 * d)
    return np.stack([lo[keep], hi[keep], d[keep]], axis=1)


def found_runs(w: Words) -> np.ndarray:
    """(start, end, period) of all runs by start and period, as far as hashes tell."""
    n_words = np.diff(w.at)
    out = [np.zeros((0, 3), np.int64)]
    soonest, size, counts = w.next_same(), 1, n_words
    heads = np.append(0, np.cumsum(counts))  # where each text's blocks begin in `soonest`
    for block, first, count in scales(int(n_words.max(initial=0))):
        while size < block:  # a block's latest return is that of its two halves
            halves = counts // 2
            at = np.append(0, np.cumsum(halves))
            child = np.arange(at[-1]) - np.repeat(at[:-1] - heads[:-1], halves) + (np.arange(at[-1]) - np.repeat(at[:-1], halves))
            soonest = np.maximum(soonest[child], soonest[child + 1])
            counts, heads, size = halves, at, 2 * size
        starts = np.repeat(w.at[:-1], counts) + size * (np.arange(heads[-1]) - np.repeat(heads[:-1], counts))
        may = soonest < first + count
        may &= starts + size + first <= np.repeat(w.at[1:], counts)
        if may.any():
            seeds, distances = occurrences(w, starts[may], size, first, count)
            if len(seeds):
                out.append(extended(w, seeds, distances, size))
    runs = np.concatenate(out)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def plain_runs(ids: np.ndarray) -> np.ndarray:
    """The same by comparing all words at every distance: for the text in which hashes took two words for one."""
    out, seen = [], set()
    for d in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[False], ids[:-d] == ids[d:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for lo, hi in zip(edges[::2].tolist(), (edges[1::2] + d).tolist(), strict=True):
            if hi - lo >= max(LEAST, 2 * d) and (lo, hi) not in seen:
                seen.add((lo, hi))
                out.append((lo, hi, d))
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all stretches, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def false_runs(runs: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which runs have two words at the distance of the period that are not the same bytes."""
    bad = np.zeros(len(runs), bool)
    owner = np.repeat(np.arange(len(runs)), runs[:, 1] - runs[:, 2] - runs[:, 0])
    first = ragged(runs[:, 0], runs[:, 1] - runs[:, 2] - runs[:, 0])
    for lo in range(0, len(first), PIECE_WORDS):
        a, run = first[lo:lo + PIECE_WORDS], owner[lo:lo + PIECE_WORDS]
        b = a + runs[run, 2]
        sizes = ends[a] - starts[a]
        uneven = sizes != ends[b] - starts[b]
        bad[run[uneven]] = True
        a, b, run, sizes = a[~uneven], b[~uneven], run[~uneven], sizes[~uneven]
        differ = data[ragged(starts[a], sizes)] != data[ragged(starts[b], sizes)]
        bad[np.repeat(run, sizes)[differ]] = True
    return bad


def runs_of_chunk(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of the texts of a chunk, in word numbers of the chunk."""
    runs = found_runs(Words(W.span_hashes(data, starts, ends), at))
    bad = false_runs(runs, data, starts, ends)
    for doc in np.unique(np.searchsorted(at, runs[bad, 0], "right") - 1).tolist():
        lo, hi = int(at[doc]), int(at[doc + 1])
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)])
        others = runs[(runs[:, 0] < lo) | (runs[:, 0] >= hi)]
        runs = np.concatenate([others, plain_runs(ids) + [lo, lo, 0]])
        runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, n_docs: int) -> pa.Array:
    """The given words of each text, joined by one space."""
    sizes = ends - starts
    gap = np.zeros(len(docs), np.int64)
    gap[:-1] = docs[1:] == docs[:-1]
    place = np.cumsum(sizes + gap) - sizes - gap
    out = np.full(int((sizes + gap).sum()), 0x20, np.uint8)
    for lo in range(0, len(sizes), PIECE_WORDS):
        part = slice(lo, lo + PIECE_WORDS)
        out[ragged(place[part], sizes[part])] = data[ragged(starts[part], sizes[part])]
    offsets = np.append(place, len(out))[np.searchsorted(docs, np.arange(n_docs + 1))]
    return pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def searched_chunk(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Number of words, runs and collapsed text of each text of a chunk."""
    starts, ends, at = W.spans(~W.SPACE[data], offsets)
    runs = runs_of_chunk(data, starts, ends, at)
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    docs = W.owners(at)
    texts = joined_words(data, starts[kept], ends[kept], docs[kept], len(at) - 1)
    doc = np.searchsorted(at, runs[:, 0], "right") - 1
    columns = [pa.array(runs[:, 0] - at[doc]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])]
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(at))).astype(np.int32)),
                                     pa.StructArray.from_arrays(columns, names=["start", "length", "period"]))
    return [pa.array(np.diff(at)), lists, texts]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs by start and period, collapsed): all runs of every text, and the text with each run cut to its first
    period and its words joined by one space."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = W.arrow_column(batch, id_col)
            for lo, hi, data, offsets in W.text_chunks(W.arrow_column(batch, text_col)):
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *searched_chunk(data, offsets)], names=[f.name for f in schema])

    return W.map_arrow(docs.select(id_col, text_col), run, schema).withColumnRenamed("id", id_col)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """`doc_id` and `text` of the contract: in a tenth of the documents all words from one on repeat with a given period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("w").cast("bigint"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rows = rows.withColumn("a", F.col("a").cast("int"))
    rest = F.size("w") - F.col("a")
    cycle = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(cycle), F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_planted_periods(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    rows = periodic_runs(docs).withColumn("top", longest)
    start, length, period = -F.col("top.s"), F.col("top.length"), -F.col("top.p")
    return rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
# all pairs of equal words, their stretches at each distance, the smallest distance of each stretch; for small tables
ORACLES = {"op11_periodic_runs": r"""
WITH ids AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CAST(doc_id AS VARCHAR) AS s FROM documents),
bits AS (SELECT *, CAST(list_concat([4294967295], list_transform(range(8 * len(s)), lambda i: (ascii(s[i // 8 + 1]) >> (i % 8)) & 1)) AS BIGINT[]) AS b FROM ids),
hashed AS (SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1)))) AS h FROM bits),
cut AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
per AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut),
docs AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN i - 1 >= a THEN w[a + (i - 1 - a) % p + 1] ELSE x END) END AS w FROM per),
word AS MATERIALIZED (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM docs),
pair AS (SELECT l.doc_id, l.i, r.i - l.i AS d FROM word l JOIN word r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i),
island AS (SELECT doc_id, d, i, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS g FROM pair),
stretch AS (SELECT doc_id, d, min(i) AS s, count(*) + d AS len FROM island GROUP BY doc_id, d, g HAVING count(*) >= d AND count(*) + d >= 12),
run AS MATERIALIZED (SELECT doc_id, s, len, min(d) AS q FROM stretch GROUP BY ALL),
best AS (SELECT doc_id, count(*) AS n_runs, arg_max({'s': s, 'len': len, 'q': q}, (len, -s, -q)) AS r,
                string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(r.s AS BIGINT) AS start, CAST(r.len AS BIGINT) AS length, CAST(r.q AS BIGINT) AS period,
       CAST(1000 * r.len // r.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""}
