"""Residual vector quantisation: fitting codebooks, encoding, residuals and quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.tiles import PART_BYTES, as_lists, book_of, matrix, minus_centroid, nearest, row_tiles, squared_distances
from seqloom.session import collect_small, materialize


def _code_matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def as_doubles(df: DataFrame, item: str, embedding: str) -> DataFrame:
    return df.select(F.col(item).cast("bigint").alias("item_id"), F.col(embedding).cast("array<double>").alias("vec"))


def codebook_frame(spark: SparkSession, books: Sequence[np.ndarray]) -> DataFrame:
    rows = [(level, code, [float(v) for v in centroid])
            for level, book in enumerate(books) for code, centroid in enumerate(book)]
    return spark.createDataFrame(rows, "level int, code int, centroid array<double>")


def n_levels(codebooks: DataFrame) -> int:
    return (codebooks.agg(F.max("level")).first()[0] or 0) + 1


def whole_books(codebooks: DataFrame, part_bytes: int | None = None) -> list | None:
    """All levels as books when together they are one part, so that one pass can take them all; else None."""
    limit = part_bytes or PART_BYTES
    values, n = codebooks.agg(F.sum(F.size("centroid")), F.count(F.lit(1))).first()
    if (values or 0) * 8 > limit:
        return None
    levels: dict[int, list] = {}
    for r in sorted(collect_small(codebooks.select("level", "code", "centroid"), n, "codebook")):
        levels.setdefault(r["level"], []).append(r["centroid"])
    return [book_of(codebooks.sparkSession, np.array(levels[k], dtype=np.float64), part_bytes=limit) for k in sorted(levels)]


def encode(vectors: DataFrame, codebooks: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """(item_id, codes): per level the nearest centroid of what earlier levels left over.

    Codebooks that fit in one part are passed in one go. Larger ones go level by level, each in as many passes as it has
    parts, merged per item.
    """
    books = whole_books(codebooks, part_bytes)
    if books is not None:
        return _encode_whole(vectors, books)
    left = vectors.select("item_id", "vec")
    codes = left.select("item_id", F.array().cast("array<int>").alias("codes"))
    levels = n_levels(codebooks)
    for level in range(levels):
        book = book_of(codebooks.sparkSession, codebooks, level, part_bytes)
        found = materialize(nearest(left, book).select("item_id", "code"), "nearest")
        codes = codes.join(found, "item_id").select("item_id", F.concat("codes", F.array("code")).alias("codes"))
        if level < levels - 1:
            left = materialize(minus_centroid(left.join(found, "item_id"), book), "residual")
    return materialize(codes, "encoded")


def _encode_whole(vectors: DataFrame, books: list, keep_residual: bool = False) -> DataFrame:
    widest = max(book.size for book in books)
    shared = [book.parts[0].centroids for book in books]

    def run(batches):
        import pyarrow as pa

        for tile, residual in row_tiles(batches, widest):
            codes = np.empty((len(residual), len(shared)), dtype=np.int32)
            for level, book in enumerate(shared):
                codes[:, level] = squared_distances(residual, book.value).argmin(1)
                residual = residual - book.value[codes[:, level]]
            columns, names = [tile.column("item_id"), as_lists(codes)], ["item_id", "codes"]
            if keep_residual:
                columns, names = [*columns, as_lists(residual)], [*names, "vec"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "item_id bigint, codes array<int>" + (", vec array<double>" if keep_residual else "")
    return vectors.select("item_id", "vec").mapInArrow(run, schema)


def residuals(vectors: DataFrame, coded: DataFrame, codebooks: DataFrame, upto: int, part_bytes: int | None = None) -> DataFrame:
    """(item_id, vec): what is left of each vector after its first `upto` levels; in parts, each row meets only its own."""
    if upto == 0:
        return vectors.select("item_id", "vec")
    left = vectors.select("item_id", "vec").join(coded.select("item_id", "codes"), "item_id")
    books = whole_books(codebooks, part_bytes)
    if books is not None:
        shared = [book.parts[0].centroids for book in books[:upto]]

        def subtract(batches):
            import pyarrow as pa

            for b in batches:
                vec, codes = matrix(b.column("vec")), _code_matrix(b.column("codes"))
                for level, book in enumerate(shared):
                    vec = vec - book.value[codes[:, level]]
                yield pa.RecordBatch.from_arrays([b.column("item_id"), as_lists(vec)], ["item_id", "vec"])

        return left.mapInArrow(subtract, "item_id bigint, vec array<double>")
    for level in range(upto):
        book = book_of(vectors.sparkSession, codebooks, level, part_bytes)
        less = minus_centroid(left.withColumn("code", F.get("codes", F.lit(level))), book)
        left = less if level == upto - 1 else less.join(coded.select("item_id", "codes"), "item_id")
    return left.select("item_id", "vec")


def next_residual(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """(item_id, vec): each vector minus its nearest centroid of a one-level codebook."""
    books = whole_books(codebook)
    if books is not None:
        return _encode_whole(vectors, books, keep_residual=True).select("item_id", "vec")
    return residuals(vectors, encode(vectors, codebook), codebook, 1)


def level_errors(vectors: DataFrame, coded: DataFrame, codebooks: DataFrame, beta: float = 0.25, part_bytes: int | None = None) -> DataFrame:
    """Per level: mean squared residual before and after it, and the quantiser loss (1 + beta) x error."""
    books = whole_books(codebooks, part_bytes)
    squares = _squares_in_one_pass(vectors, coded, books) if books is not None else _squares_by_level(vectors, coded, codebooks, part_bytes)
    sums = squares.groupBy("level").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.sum("n").alias("n"))
    after = F.col("a") / F.col("n")
    return sums.select("level", (F.col("b") / F.col("n")).alias("mse_before"), after.alias("mse_after"), (after * (1 + beta)).alias("loss"))


def _squares_in_one_pass(vectors: DataFrame, coded: DataFrame, books: list) -> DataFrame:
    """One join and one pass: each task adds up its squares for all levels."""
    shared = [book.parts[0].centroids for book in books]

    def squares(batches):
        import pyarrow as pa

        for b in batches:
            left, codes = matrix(b.column("vec")), _code_matrix(b.column("codes"))
            before, after = [], []
            for level, book in enumerate(shared):
                before.append(float((left * left).sum()))
                left = left - book.value[codes[:, level]]
                after.append(float((left * left).sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(before), dtype=np.int32)), pa.array(before), pa.array(after), pa.array([left.size] * len(before))],
                ["level", "b", "a", "n"])

    return vectors.select("item_id", "vec").join(coded.select("item_id", "codes"), "item_id").mapInArrow(
        squares, "level int, b double, a double, n bigint")


def _squares_by_level(vectors: DataFrame, coded: DataFrame, codebooks: DataFrame, part_bytes: int | None) -> DataFrame:
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    left, out = vectors.select("item_id", "vec"), None
    for level in range(n_levels(codebooks)):
        book = book_of(vectors.sparkSession, codebooks, level, part_bytes)
        rows = left.join(coded.select("item_id", F.get("codes", F.lit(level)).alias("code")), "item_id")
        before = rows.select(F.lit(level).alias("level"), square.alias("b"), F.lit(0.0).alias("a"), F.size("vec").cast("bigint").alias("n"))
        left = materialize(minus_centroid(rows, book), "residual")
        after = left.select(F.lit(level).alias("level"), F.lit(0.0).alias("b"), square.alias("a"), F.lit(0).cast("bigint").alias("n"))
        both = before.unionByName(after)
        out = both if out is None else out.unionByName(both)
    return out


def mean_vectors(df: DataFrame, key: str, vec: str, count: bool = False) -> DataFrame:
    """Mean vector per key with Spark ML's map-side-combining summariser."""
    metrics = Summarizer.metrics("mean", "count").summary(array_to_vector(vec))
    grouped = df.groupBy(key).agg(metrics.alias("__s"))
    return grouped.select(key, vector_to_array("__s.mean").alias("centroid"), *([F.col("__s.count").alias("n")] if count else []))


def codebooks_from_classes(vectors: DataFrame, classes: DataFrame, levels: int) -> DataFrame:
    """Codebooks whose centroids are mean residuals per given class: a fixed, reproducible quantiser.

    `classes` is (item_id, code) with dense codes from 0.
    """
    books, left = None, materialize(vectors, "vectors")
    for level in range(levels):
        means = mean_vectors(left.join(classes, "item_id"), "code", "vec").select(
            F.lit(level).alias("level"), F.col("code").cast("int").alias("code"), "centroid")
        means = materialize(means, "codebook")
        books = means if books is None else books.unionByName(means)
        left = materialize(next_residual(left, means.withColumn("level", F.lit(0))), "residual")
    return books


def fit_residual_kmeans(
    vectors: DataFrame, k: int | Sequence[int], levels: int, max_iter: int = 100, seed: int = 42, tol: float = 1e-4,
) -> tuple[DataFrame, DataFrame]:
    """(codebooks, codes): per level a Spark ML k-means on what the earlier levels left over."""
    spark = vectors.sparkSession
    ks = [k] * levels if isinstance(k, int) else list(k)
    left, books = materialize(vectors.select("item_id", "vec"), "residual"), []
    for level, size in enumerate(ks):
        data = left.withColumn("features", array_to_vector("vec"))
        model = KMeans(k=size, maxIter=max_iter, seed=seed + level, tol=tol, featuresCol="features").fit(data)
        book = np.array(model.clusterCenters())
        books.append(book)
        left = materialize(next_residual(left, codebook_frame(spark, [book])), "residual")
    frame = codebook_frame(spark, books)
    return frame, materialize(encode(vectors, frame), "codes")


def masked_mean(tokens: DataFrame, item: str, vec: str, mask: str, dim: int) -> DataFrame:
    """Mean of the unmasked token vectors per item; an item with none gets zeros."""
    means = mean_vectors(tokens.filter(F.col(mask) > 0), item, vec)
    zeros = F.array_repeat(F.lit(0.0), dim)
    return tokens.select(item).distinct().join(means, item, "left").select(item, F.coalesce("centroid", zeros).alias("embedding"))


def embed_texts(texts: DataFrame, item: str, text: str, encoder=None, dim: int = 64) -> DataFrame:
    """(item, embedding) by a caller-supplied batch encoder `list[str] -> (n, d) array`, run on Arrow batches.

    Without one, words are hashed into `dim` counts by Spark ML; a missing text has none.
    """
    if encoder is None:
        from pyspark.ml.feature import HashingTF

        words = texts.select(item, F.coalesce(F.split(text, r"\s+"), F.array().cast("array<string>")).alias("words"))
        hashed = HashingTF(numFeatures=dim, inputCol="words", outputCol="tf").transform(words)
        return hashed.select(item, vector_to_array("tf", "float32").alias("embedding"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = np.asarray(encoder(b.column(1).to_pylist()), dtype=np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), as_lists(out)], [item, "embedding"])

    kind = texts.schema[item].dataType.simpleString()
    return texts.select(item, text).mapInArrow(run, f"{item} {kind}, embedding array<float>")
