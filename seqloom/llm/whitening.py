"""Whitening of vectors by the exact covariance of their scaled integers.

Every entry c becomes the integer x = floor(64 c) + 1000000. A task writes the entries of a block of rows, shifted to start at
zero in each dimension, as bit planes: one bit per row, packed into 64-bit words. The number of ones two planes share, times
the weights of both, summed over all planes of two dimensions, is their exact cross-product. Sums and cross-products, with the
shifts put back, add up as integers over tasks; they are centred as integers (n * sum of products - product of sums) before
anything is divided. Only then `eigh` takes the small matrix, and a second pass projects the rows. A third one measures the
covariance of what comes out.

Only numbers of the model reach the driver: d (d + 1) / 2 cross-products, d sums, 32 x 32 products. Integer sums travel as two
halves, so no sum over tasks can overflow.

Defined results. A vector that is null or has null or non-finite entries is left out, and so is one whose length is not the
table's commonest (among equals the longest). Repeated rows and ids: every row is a vector. Null ids stay null. Empty table: no
rows. Components whose eigenvalue is zero up to rounding cannot be whitened and are left out, so equal vectors give no rows.
Entries beyond 2**21 or a deviation beyond 64 bits raise an error instead of a wrong number. Other columns are not part of the
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import words as W
from seqloom.session import collect_small

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
BLOCK_ROWS, PLANE_WORDS, MAX_DIM, LARGEST = 4096, 1 << 18, 8192, 1 << 27
HALF = 32


def fit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the vectors of the fit, and their length."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size("vec") > 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(fine)
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    dim = top["dim"] if top else 0
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries; the matrix of more than {MAX_DIM} does not belong on one machine")
    return rows.where(F.size("vec") == dim), dim


def scaled(column: pa.Array, dim: int) -> np.ndarray:
    """The integers x - 1000000 of a batch of vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    y = np.floor(SCALE * flat)
    if len(y) and np.abs(y).max() >= LARGEST:
        raise OverflowError(f"an entry beyond {LARGEST // SCALE} cannot be summed exactly")
    return y.astype(np.int64)


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes as 64-bit words, dimension of each plane, its bit) of the columns of non-negative integers, in dimension order."""
    n, dim = shifted.shape
    width = [int(x).bit_length() for x in shifted.max(axis=0)] if n else [0] * dim
    of = np.repeat(np.arange(dim), width)
    bit = np.concatenate([np.arange(w) for w in width]) if len(of) else np.zeros(0, np.int64)
    flags = (shifted.T[of] >> bit[:, None]) & 1
    packed = np.packbits(flags.astype(np.uint8), axis=1)
    padded = np.zeros((len(of), -(-n // 64) * 8), np.uint8)
    padded[:, :packed.shape[1]] = packed
    return padded.view(np.uint64), of, bit


def cross_products(shifted: np.ndarray) -> np.ndarray:
    """Exact sums over rows of the products of all pairs of columns: weighted counts of the ones that two planes share."""
    dim = shifted.shape[1]
    planes, of, bit = bit_planes(shifted)
    counts = np.zeros((len(of), len(of)), np.int64)
    step = max(1, PLANE_WORDS // max(planes.size, 1))
    for lo in range(0, len(of), step):  # the upper triangle of plane pairs, some rows of it at a time
        both = planes[lo:lo + step, None, :] & planes[None, lo:, :]
        counts[lo:lo + step, lo:] = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
    counts = np.triu(counts) + np.triu(counts, 1).T
    weighted = counts << (bit[:, None] + bit[None, :])
    used, first = np.unique(of, return_index=True)
    out = np.zeros((dim, dim), np.int64)
    if len(used):
        out[np.ix_(used, used)] = np.add.reduceat(np.add.reduceat(weighted, first, axis=0), first, axis=1)
    return out


def block_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact column sums and sums of products of a block of signed integers."""
    low = y.min(axis=0)
    shifted = y - low
    s, n = shifted.sum(axis=0), len(y)
    products = cross_products(shifted) + low[:, None] * s[None, :] + s[:, None] * low[None, :] + n * low[:, None] * low[None, :]
    return s + n * low, products


def moments(rows: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums and sums of products of y = x - 1000000, all exact."""
    i, j = np.triu_indices(dim)
    cells = np.concatenate([np.zeros(1, np.int64), 1 + np.arange(dim), 1 + dim + np.arange(len(i))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
        for batch in batches:
            y = scaled(W.arrow_column(batch, "vec"), dim)
            # blocks so small that no product sum leaves 62 bits
            step = BLOCK_ROWS if not len(y) else int(min(BLOCK_ROWS, max(1, (1 << 60) // max(1, 4 * int(np.abs(y).max()) ** 2))))
            for at in range(0, len(y), step):
                block = y[at:at + step]
                sums, products = block_sums(block)
                values = np.concatenate([[len(block)], sums, products[i, j]])
                hi += values >> HALF
                lo += values & ((1 << HALF) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(hi), pa.array(lo)], names=["cell", "hi", "lo"])

    parts = rows.select("vec").mapInArrow(run, "cell bigint, hi bigint, lo bigint")
    wide = "decimal(38,0)"
    sums = parts.groupBy("cell").agg(F.sum(F.col("hi").cast(wide)).alias("hi"), F.sum(F.col("lo").cast(wide)).alias("lo"))
    found = {r["cell"]: (int(r["hi"]) << HALF) + int(r["lo"]) for r in collect_small(sums, len(cells), "moments")}
    n = found.get(0, 0)
    s = [found.get(1 + k, 0) for k in range(dim)]
    products = [[0] * dim for _ in range(dim)]
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        products[a][b] = products[b][a] = found.get(1 + dim + k, 0)
    return n, s, products


@dataclass
class Model:
    """What projects a row: its size does not depend on the number of rows."""

    n: int
    sums: np.ndarray  # sums of y per dimension, exact
    axes: np.ndarray  # (dim, components), unit columns by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float


def fit(n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS) -> Model:
    """Eigenvectors of the covariance, centred as integers before anything is rounded."""
    dim = len(sums)
    centred = [[n * products[a][b] - sums[a] * sums[b] for b in range(dim)] for a in range(dim)]
    square = n * n
    covariance = np.array([[c / square for c in row] for row in centred], np.float64).reshape(dim, dim)  # int / int rounds once
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(centred[a][a] for a in range(dim)) / square
    # equal on every machine: the largest entry of an axis is positive
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    usable = values[order] > dim * np.finfo(np.float64).eps * max(trace, 0.0)
    if max(map(abs, sums)) >= 1 << 62:
        raise OverflowError("sums beyond 62 bits")
    return Model(n, np.array(sums, np.int64), axes[:, usable], values[order][usable], trace)


def project(y: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(deviation, whitened) of a batch."""
    if model.n * (int(np.abs(y).max(initial=0)) + LARGEST) >= 1 << 62:
        raise OverflowError("centred integers beyond 62 bits")
    centred = model.n * y - model.sums
    if len(centred) and (centred.astype(np.float64) ** 2).sum(axis=1).max() >= 2.0 ** 63:
        raise OverflowError("a deviation beyond 64 bits")
    return (centred * centred).sum(axis=1), (centred / model.n) @ model.axes / np.sqrt(model.eigenvalues)


def identity_error(rows: DataFrame, dim: int, model: Model) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(model.eigenvalues)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    cells = np.arange(k * k + k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells))
        for batch in batches:
            _, white = project(scaled(W.arrow_column(batch, "vec"), dim), shared.value)
            total += np.concatenate([(white.T @ white).ravel(), white.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total)], names=["cell", "v"])

    sums = rows.select("vec").mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    total = np.zeros(len(cells))
    for r in collect_small(sums, len(cells), "products"):
        total[r["cell"]] = r["v"]
    mean = total[k * k:] / model.n
    return float(np.abs(total[:k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows, dim = fit_rows(vectors, id_col, vector_col)
    id_type = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    model = fit(*moments(rows, dim), components) if dim else None
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error = identity_error(rows, dim, model)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.eigenvalues)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS // 4):
                part = batch.slice(lo, BLOCK_ROWS // 4)
                deviation, white = project(scaled(W.arrow_column(part, "vec"), dim), own)
                m = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [W.arrow_column(part, "id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, own.n)), pa.array(np.repeat(deviation, k)), pa.array(white.ravel()),
                     pa.array(np.tile(own.eigenvalues / own.trace, m)), pa.array(np.full(m * k, error))], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_whiten(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op13_whiten": op13_whiten}
ORACLES: dict[str, str] = {}
