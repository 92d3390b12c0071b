"""Codebooks in parts of bounded size, and the passes of rows over them.

A codebook of any size is a list of parts of at most `PART_BYTES`, each fetched from its table and shipped by itself. A task
holds one part and a tile of at most `CELLS` row x code numbers. What a pass over one part finds per row (the nearest code, the
best few, a partial sum) is merged per item where there is more than one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import collect_small

PART_BYTES = 64 << 20
CELLS = 1 << 21


class Part(NamedTuple):
    """Codes from `start` on with their centroids, one row each."""

    start: int
    size: int
    centroids: Broadcast


class Book(NamedTuple):
    """One level of a codebook."""

    size: int
    parts: list[Part]

    def slices(self, per_code: np.ndarray) -> list[np.ndarray]:
        """A number per code, cut like the parts."""
        return [per_code[p.start:p.start + p.size] for p in self.parts]

    def release(self) -> None:
        """Delete the shipped parts; for books made inside a loop."""
        for part in self.parts:
            part.centroids.destroy()


def book_of(spark: SparkSession, source: np.ndarray | DataFrame | Book, level: int = 0, part_bytes: int | None = None) -> Book:
    """A codebook level from an array, from a table (level, code, centroid) with dense codes, or as it is."""
    if isinstance(source, Book):
        return source
    limit, sc = part_bytes or PART_BYTES, spark.sparkContext
    if isinstance(source, np.ndarray):
        step = max(1, limit // (8 * max(1, source.shape[1])))
        return Book(len(source), [Part(lo, len(source[lo:lo + step]), sc.broadcast(source[lo:lo + step])) for lo in range(0, len(source), step)])
    rows = source.filter(F.col("level") == level)
    n, top, dim = rows.agg(F.count(F.lit(1)), F.max("code"), F.max(F.size("centroid"))).first()
    if n and top != n - 1:
        raise ValueError(f"level {level}: codes are not 0 to {n - 1}")
    step, parts = max(1, limit // (8 * max(1, dim or 1))), []
    for lo in range(0, n, step):
        found = collect_small(rows.filter(F.col("code").between(lo, lo + step - 1)).select("code", "centroid"), step, "part of a codebook")
        block = np.array([r["centroid"] for r in sorted(found, key=lambda r: r["code"])], dtype=np.float64)
        parts.append(Part(lo, len(block), sc.broadcast(block)))
    return Book(n, parts)


def matrix(column) -> np.ndarray:
    """Arrow list column of equal lengths to an (n, d) double array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), -1)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1, keepdims=True) + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)


def row_tiles(batches, n_codes: int, column: str = "vec") -> Iterator[tuple]:
    """(batch part, its vectors) with at most `CELLS` row x code numbers, one row at least."""
    step = max(1, CELLS // max(1, n_codes))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, matrix(part.column(column))


def over_parts(rows: DataFrame, book: Book, make: Callable[[int, Part], Callable], schema: str) -> DataFrame:
    """One pass of `rows` for each part of the book, one result below the other."""
    passes = [rows.mapInArrow(make(i, part), schema) for i, part in enumerate(book.parts)]
    return reduce(DataFrame.unionByName, passes)


def nearest(rows: DataFrame, book: Book) -> DataFrame:
    """(item_id, distance, code): the nearest centroid of every vector; the lower code among equals."""

    def make(_, part: Part):
        def run(batches):
            import pyarrow as pa

            c = part.centroids.value
            for tile, x in row_tiles(batches, len(c)):
                d = squared_distances(x, c)
                code = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [tile.column("item_id"), pa.array(d[np.arange(len(code)), code]), pa.array((code + part.start).astype(np.int32))],
                    ["item_id", "distance", "code"])

        return run

    found = over_parts(rows.select("item_id", "vec"), book, make, "item_id bigint, distance double, code int")
    if len(book.parts) == 1:
        return found
    best = found.groupBy("item_id").agg(F.min(F.struct("distance", "code")).alias("best"))
    return best.select("item_id", "best.distance", "best.code")


def minus_centroid(rows: DataFrame, book: Book) -> DataFrame:
    """(item_id, vec): each vector of (item_id, vec, code) less the centroid of its code. Every row meets its own part only."""

    def make(part: Part):
        def run(batches):
            import pyarrow as pa

            c = part.centroids.value
            for tile, x in row_tiles(batches, 1):
                left = x - c[tile.column("code").to_numpy() - part.start]
                yield pa.RecordBatch.from_arrays([tile.column("item_id"), as_lists(left)], ["item_id", "vec"])

        return run

    passes = []
    for part in book.parts:
        own = rows if len(book.parts) == 1 else rows.filter(F.col("code").between(part.start, part.start + part.size - 1))
        passes.append(own.select("item_id", "vec", "code").mapInArrow(make(part), "item_id bigint, vec array<double>"))
    return reduce(DataFrame.unionByName, passes)


def as_lists(rows: np.ndarray):
    import pyarrow as pa

    flat = pa.array(np.ascontiguousarray(rows).ravel())
    return pa.FixedSizeListArray.from_arrays(flat, rows.shape[1]).cast(pa.list_(flat.type))
