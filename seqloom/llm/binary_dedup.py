"""Near-duplicate vectors by cosine, through binary codes of randomly rotated vectors.

A vector is rotated at random and each coordinate keeps its sign. The sign vector and a stored correction factor (its inner
product with the rotated vector) give an unbiased estimate of the inner product with any other vector, with an error bound
that shrinks with the square root of the code length. Only pairs whose upper bound reaches the threshold are computed again,
in double precision.

Which pairs meet at all: bands of the same signs. Their width follows the number of vectors and their number is such that a
pair right at the threshold misses every band with probability `miss` (closer pairs far less). A pair is counted in the
first band it shares. A crowded band key is cut into blocks, and each task compares two blocks, so no group is held whole
and no pairs are written: a task returns per vector the number of its links and a label of what it is connected to.

Equal vectors form a class first; a class counts with its size. Vectors are compared within the same dimension.

Defined results. Null or zero vectors and vectors with null or non-finite parts: no links, a component of their own.
Repeated rows and ids: every row is a vector. Null ids: never a component's id unless all of it are null. Empty table:
empty result. Other columns are not part of the result; internal columns start with `_b_`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import words as W
from seqloom.llm.components import connected_components, discard, stored

THRESHOLD, MISS, SEED = 0.95, 1e-5, 20240531
CODE_BITS, BLOCK_ROWS, SIGMAS = 256, 1024, 6.0
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, turn: int) -> np.ndarray:
    """Columns of a seeded random orthogonal matrix that act on a vector padded with zeros to the code length."""
    if (dim, turn) not in _ROTATIONS:
        size = max(CODE_BITS, -(-dim // 64) * 64)
        q, r = np.linalg.qr(np.random.default_rng([SEED, dim, turn]).standard_normal((size, size)))
        _ROTATIONS[dim, turn] = np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dim])
    return _ROTATIONS[dim, turn]


def band_plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits per band for `n` vectors, and how many bands keep misses at the threshold below `miss`."""
    bits = min(24, max(6, round(math.log2(max(n, 1) / 16 + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


class Codes:
    """Codes, correction factors and coarse copies of a batch of vectors of one dimension."""

    def __init__(self, vectors: np.ndarray):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        turned = unit @ rotation(unit.shape[1], 0).T
        self.bits = turned > 0
        self.factor = (np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])).astype(np.float32)
        self.scale = (np.abs(unit).max(axis=1) / 127).astype(np.float32)
        self.coarse = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.unit = unit

    def payloads(self) -> list[bytes]:
        packed = np.packbits(self.bits, axis=1)
        rows = np.concatenate([packed, self.factor[:, None].view(np.uint8), self.scale[:, None].view(np.uint8), self.coarse.view(np.uint8)], axis=1)
        return [r.tobytes() for r in rows]

    def keys(self, bits: int, bands: int) -> np.ndarray:
        """Band keys, with the dimension above the bits; further rotations give more signs where one has too few."""
        size, dim = self.bits.shape[1], self.unit.shape[1]
        turns = -(-bits * bands // size)
        signs = np.concatenate([self.bits] + [self.unit @ rotation(dim, t).T > 0 for t in range(1, turns)], axis=1)[:, :bits * bands]
        weights = (1 << np.arange(bits)).astype(np.int64)
        return signs.reshape(len(signs), bands, bits).astype(np.int64) @ weights + (dim << 24)


def upper_bounds(payloads: list[bytes], key: int) -> np.ndarray:
    """Upper confidence bounds of all inner products among the vectors of a bucket: row as code, column as query."""
    dim = key >> 24
    size = rotation(dim, 0).shape[0]
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1)
    code = size // 8
    signs = np.unpackbits(raw[:, :code], axis=1).astype(np.float32) * 2 - 1
    factor = np.ascontiguousarray(raw[:, code:code + 4]).view(np.float32)
    scale = np.ascontiguousarray(raw[:, code + 4:code + 8]).view(np.float32)
    query = (np.ascontiguousarray(raw[:, code + 8:]).view(np.int8) * scale) @ rotation(dim, 0).T.astype(np.float32)
    estimate = (signs @ query.T) / (math.sqrt(size) * factor)
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(size - 1)
    # the coarse copy is off by at most half a step in each part
    return estimate + SIGMAS * spread + (scale[:, 0] * (math.sqrt(dim) / 2))[None, :] / factor


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Neighbouring rows with equal values of `by`, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([W.arrow_column(batch, c).to_numpy(zero_copy_only=False) for c in by])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            now = tuple(values[:, lo])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of (band, key, node, ...) dealt to pairs of blocks (p, q) of their bucket and sorted by bucket and pair.

    A bucket of up to `block_rows` rows is one block. A larger one has as many as it needs, and a row goes to every pair that
    has its own block `sub`.
    """
    crowded, _ = stored(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_b_n")).where(F.col("_b_n") > block_rows), "crowded")
    blocks = F.coalesce(F.ceil(F.col("_b_n") / block_rows), F.lit(1)).cast("int")
    dealt = (rows.join(crowded, ["band", "key"], "left").withColumn("_b_k", blocks)
             .withColumn("sub", F.pmod(F.xxhash64("node"), F.col("_b_k")).cast("int"))
             .withColumn("_b_o", F.explode(F.sequence(F.lit(0), F.col("_b_k") - 1)))
             .withColumn("p", F.least("sub", "_b_o")).withColumn("q", F.greatest("sub", "_b_o")).drop("_b_n", "_b_k", "_b_o"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "band", "key", "p", "q").sortWithinPartitions("band", "key", "p", "q", "node")


def _across(sub: np.ndarray) -> np.ndarray:
    """Pairs (row before column) that a block pair is in charge of: all of one block, or those between two."""
    n = len(sub)
    upper = np.arange(n)[:, None] < np.arange(n)[None, :]
    return upper if sub.min() == sub.max() else upper & (sub[:, None] != sub[None, :])


def _screen(threshold: float):
    """Vectors of a bucket with at least one partner whose upper bound reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["band", "key", "p", "q"]):
            if rows.num_rows < 2:
                continue
            sub = rows["sub"].to_numpy()
            if sub.min() == sub.max() and rows["p"][0] != rows["q"][0]:
                continue
            near = (upper_bounds(rows["payload"].to_pylist(), rows["key"][0].as_py()) >= threshold) & _across(sub)
            hit = near.any(axis=0) | near.any(axis=1)
            if hit.any():
                yield from rows.select(["band", "key", "node"]).filter(pa.array(hit)).to_batches()
    return run


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row."""
    labels = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, labels[None, :], len(labels)).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _recompute(threshold: float):
    """Exact cosines within a block pair: per vector the linked copies counted here, and a connected vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["band", "key", "p", "q"]):
            sub = rows["sub"].to_numpy()
            if rows.num_rows < 2 or (sub.min() == sub.max() and rows["p"][0] != rows["q"][0]):
                continue
            vectors = np.array(rows["vec"].to_pylist(), np.float64)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            linked = (unit @ unit.T >= threshold) & _across(sub)
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            keys, band = np.array(rows["keys"].to_pylist(), np.int64), rows["band"][0].as_py()
            first = np.ones(len(i), bool)
            for lo in range(0, len(i), 1 << 16):
                a, b = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
                first[lo:lo + (1 << 16)] = ~(keys[a, :band] == keys[b, :band]).any(axis=1)
            size = rows["size"].to_numpy()
            count = np.zeros(len(vectors), np.int64)
            np.add.at(count, i[first], size[j[first]])
            np.add.at(count, j[first], size[i[first]])
            labels = _labels(linked | linked.T)
            node = rows["node"].to_numpy()
            keep = linked.any(axis=0) | linked.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(node[labels][keep]), pa.array(count[keep])],
                                             names=["node", "label", "links"])
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    miss: float = MISS) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly) and component_id (smallest id reachable)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    classes, _ = stored(rows.where("ok").groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
                        .withColumn("node", F.monotonically_increasing_id()), "classes")
    bits, bands = band_plan(classes.count(), threshold, miss)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                node, raw = W.arrow_column(part, "node").to_numpy(), W.arrow_column(part, "vec").to_pylist()
                lengths = np.array([len(v) for v in raw])
                for dim in np.unique(lengths):
                    at = np.flatnonzero(lengths == dim)
                    codes = Codes(np.array([raw[i] for i in at], np.float64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[at]), pa.array(codes.payloads(), pa.binary()), pa.array(list(codes.keys(bits, bands)), pa.list_(pa.int64()))],
                        names=["node", "payload", "keys"])

    codes, codes_path = stored(classes.select("node", "vec").mapInArrow(encode, "node bigint, payload binary, keys array<bigint>"), "codes")
    met = codes.select("node", "payload", F.posexplode("keys").alias("band", "key"))
    screened, screened_path = stored(in_blocks(met).mapInArrow(_screen(threshold), "band int, key bigint, node bigint").distinct(), "screened")
    full = screened.join(codes.select("node", "keys"), "node").join(classes.select("node", "vec", "size"), "node")
    found, found_path = stored(in_blocks(full).mapInArrow(_recompute(threshold), "node bigint, label bigint, links bigint"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    named = (classes.join(parts, "node", "left").join(links, "node", "left")
             .select("vec", "rep", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    named, _ = stored(named, "named")
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(names, "component").select("vec", "n_links", "component_id")
    for path in (codes_path, screened_path, found_path):
        discard(vectors.sparkSession, path)
    good = rows.where("ok").join(named, "vec").select("id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(alone).withColumnRenamed("id", id_col)


def op10_binary_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


QUERIES = {"op10_binary_dedup": op10_binary_dedup}
# every pair; for the small tables of the comparison only
ORACLES = {"op10_binary_dedup": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""}
