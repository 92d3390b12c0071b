"""Two-dimensional NumPy array files, row-major or column-major, read and written by tasks."""

from __future__ import annotations

import ast
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import durable_path, stored

TASK_BYTES = 64 << 20
SHAPES = "file string, first bigint, start bigint, rows bigint, dim bigint, kind string, by_column boolean"


def open_store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _header(handle) -> tuple[int, int, int, str, bool]:
    """(first data byte, rows, entries a row, number type, column-major) of an open file."""
    magic = handle.read(8)
    size = struct.unpack("<H", handle.read(2))[0] if magic[6] == 1 else struct.unpack("<I", handle.read(4))[0]
    head = ast.literal_eval(handle.read(size).decode("latin1"))
    rows, dim = head["shape"]
    return handle.tell(), rows, dim, head["descr"], head["fortran_order"]


def read_npy_files(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(item_id, embedding) of array files (file, first): row i of a file is item `first` + i.

    Tasks read headers and then row ranges. In a column-major file a range is a tile: its stretch of every column, transposed.
    """

    def shapes(batches):
        import pyarrow as pa

        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                system, inner = open_store(file)
                with system.open_input_file(inner) as handle:
                    found = _header(handle)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (file, first, *found)], [c.split()[0] for c in SHAPES.split(", ")])

    known, _ = stored(files.select("file", "first").mapInArrow(shapes, SHAPES), "array-headers")
    width = F.regexp_extract("kind", r"(\d+)$", 1).cast("bigint") * F.col("dim")
    step = F.greatest(F.lit(1), F.floor(F.lit(task_bytes) / F.greatest(width, F.lit(1)))).cast("bigint")
    ranges = known.where("rows > 0").withColumn("step", step).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, F.col("step"))))
    n_ranges = max(1, ranges.count())

    def load(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                kind, n, dim = np.dtype(r["kind"]), min(r["step"], r["rows"] - r["lo"]), r["dim"]
                system, inner = open_store(r["file"])
                with system.open_input_file(inner) as handle:
                    if r["by_column"]:
                        tile = np.empty((n, dim), kind)
                        for c in range(dim):
                            handle.seek(r["start"] + (c * r["rows"] + r["lo"]) * kind.itemsize)
                            tile[:, c] = np.frombuffer(handle.read(n * kind.itemsize), kind)
                    else:
                        handle.seek(r["start"] + r["lo"] * dim * kind.itemsize)
                        tile = np.frombuffer(handle.read(n * dim * kind.itemsize), kind)
                flat = pa.array(np.ascontiguousarray(tile).ravel().astype("float32"))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * dim).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(r["first"] + r["lo"] + np.arange(n, dtype="int64")), lists], ["item_id", "embedding"])

    return ranges.repartition(n_ranges, "file", "lo").mapInArrow(load, "item_id bigint, embedding array<float>")


def read_npy(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One array file as (item_id = row number, embedding), by row ranges."""
    return read_npy_files(spark.createDataFrame([(path, 0)], "file string, first bigint"), task_bytes)


def write_npy_files(vectors: DataFrame, item: str, embedding: str, dim: int, by_column: bool = False) -> DataFrame:
    """Manifest (file, first) of array files of vectors with dense ids, one for each range of ids; files are complete once listed.

    A task holds its range as one array, as the header needs the number of rows; the session's partitions set the size.
    """
    spark = vectors.sparkSession
    folder = durable_path(spark, "arrays")

    def write(batches):
        import io
        import uuid

        import pyarrow as pa

        ids, parts = [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy())
                parts.append(batch.column(1).flatten().to_numpy().reshape(-1, dim).astype("float32"))
        if not ids:
            return
        ids, rows = np.concatenate(ids), np.concatenate(parts)
        if (np.diff(ids) != 1).any():
            raise ValueError("ids of an array file must follow one another")
        system, root = open_store(folder)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.npy"
        body = io.BytesIO()
        np.save(body, np.asfortranarray(rows) if by_column else rows)
        with system.open_output_stream(f"{root}/{name}") as sink:
            sink.write(body.getbuffer())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([int(ids[0])])], ["file", "first"])

    rows = vectors.select(item, embedding).repartitionByRange(item).sortWithinPartitions(item)
    return stored(rows.mapInArrow(write, "file string, first bigint"), "array-files")[0]
