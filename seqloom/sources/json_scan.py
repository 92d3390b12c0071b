"""Entries of JSON objects and arrays of any size, also when they stand on one line, read by several tasks.

Spark's text reader cuts a file at commas, so every task gets a stretch of its own that begins after one. Whether a comma
separates entries depends on what came before: a first pass adds up, per stretch, how quotes and brackets change the state, for
both cases of starting inside a string or outside. One row per stretch is enough to know where each really starts. A second pass
cuts at the commas of depth one; pieces of entries that cross stretches are put together by their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, BACKSLASH, COMMA = 0x22, 0x5C, 0x2C
SPLITS = 1_000_000  # stretches of a whole folder the driver will take in
SUMMARY = "file string, block bigint, flips bigint, rise0 bigint, rise1 bigint, opener string"


def pieces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, value): the text between commas; a stretch of a file is named by its first byte."""
    rows = spark.read.text(paths, lineSep=",")
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _stretches(batches) -> Iterator[tuple[str, int, np.ndarray, bool]]:
    """(file, block, bytes with a comma after every piece, whether the stretch begins here) of neighbouring rows."""
    last = None
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        values = batch.column("value").to_pylist()
        lo = 0
        while lo < len(values):
            hi = lo + 1
            while hi < len(values) and blocks[hi] == blocks[lo] and files[hi] == files[lo]:
                hi += 1
            here = (files[lo], blocks[lo])
            yield *here, np.frombuffer((",".join(values[lo:hi]) + ",").encode(), np.uint8), here != last
            last, lo = here, hi


def quotes(data: np.ndarray) -> np.ndarray:
    """Where a quote opens or closes a string: it stands behind an even number of backslashes."""
    escape = data == BACKSLASH
    at = np.arange(len(data))
    run = at - np.maximum.accumulate(np.where(escape, -1, at))  # how many backslashes end here
    before = np.append(0, run[:-1])
    return (data == QUOTE) & (before % 2 == 0)


def depths(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(whether a byte belongs to a string, rise of the bracket depth up to it) when the first one stands `inside` a string or not."""
    flips = quotes(data)
    string = (np.cumsum(flips) - flips + inside) % 2 == 1
    rise = np.isin(data, (0x5B, 0x7B)).astype(np.int64) - np.isin(data, (0x5D, 0x7D))
    return string, np.cumsum(np.where(string, 0, rise))


def _summaries(batches):
    import pyarrow as pa

    now, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, *state)], ["file", "block", "flips", "rise0", "rise1", "opener"])

    for file, block, data, fresh in _stretches(batches):
        if fresh:
            if now:
                yield row()
            now, state = (file, block), [0, 0, 0, ""]
        flips = int(quotes(data).sum())
        ends = [int(depths(data, inside)[1][-1]) for inside in (False, True)]
        if state[0] % 2:
            ends.reverse()  # these bytes start in the other state than the stretch did
        state[0] += flips
        state[1], state[2] = state[1] + ends[0], state[2] + ends[1]
        if not state[3]:
            state[3] = data.tobytes().decode(errors="replace").lstrip("﻿ \t\r\n")[:1]
    if now:
        yield row()


def file_forms(spark: SparkSession, paths: str | list[str]) -> tuple[dict[str, str], dict[tuple[str, int], tuple[bool, int]]]:
    """The first character of every file, and the state (inside a string, depth) each stretch starts in."""
    rows = pieces(spark, paths).mapInArrow(_summaries, SUMMARY).limit(SPLITS + 1).collect()
    if len(rows) > SPLITS:
        raise ValueError(f"more than {SPLITS} stretches of text")
    opener, starts = {}, {}
    inside, depth, last = False, 0, None
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if r["file"] != last:
            inside, depth, last = False, 0, r["file"]
            opener[last] = r["opener"]
        starts[r["file"], r["block"]] = (inside, depth)
        depth += r["rise1"] if inside else r["rise0"]
        inside ^= bool(r["flips"] % 2)
    return opener, starts


def entries(spark: SparkSession, paths: str | list[str], starts: dict[tuple[str, int], tuple[bool, int]] | None = None) -> DataFrame:
    """(entry): the text of every entry of the objects or arrays in the files, without the outer brackets."""
    if starts is None:
        starts = file_forms(spark, paths)[1]
    shared = spark.sparkContext.broadcast(starts)  # one row per stretch

    def cut(batches):
        import pyarrow as pa

        held, number, state, now = [], 0, (False, 0), None

        def rows(found, first, tail):
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(found)), pa.array([now[1]] * len(found)), pa.array(np.arange(first, first + len(found))), pa.array(found), pa.array([tail] * len(found))],
                ["file", "block", "number", "entry", "tail"])

        for file, block, data, fresh in _stretches(batches):
            if fresh:
                if now:
                    yield rows([b"".join(held).decode()], number, True)
                held, number, now = [], 0, (file, block)
                state = shared.value[now]
            string, rise = depths(data, state[0])
            ends = np.flatnonzero((data == COMMA) & ~string & (rise + state[1] == 1))
            raw, lo, found = data.tobytes(), 0, []
            for end in ends.tolist():
                found.append((b"".join(held) + raw[lo:end]).decode())
                held, lo = [], end + 1
            held.append(raw[lo:])
            state = (bool((int(quotes(data).sum()) + state[0]) % 2), state[1] + int(rise[-1]))
            if found:
                yield rows(found, number, False)
                number += len(found)
        if now:
            yield rows([b"".join(held).decode()], number, True)

    found = pieces(spark, paths).mapInArrow(cut, "file string, block bigint, number bigint, entry string, tail boolean")
    whole = found.filter(~F.col("tail") & (F.col("number") > 0)).select("file", "entry")
    # a stretch's first entry goes on from the stretches before it, its last one into those after it: a few rows per stretch
    ends = found.filter(F.col("tail") | (F.col("number") == 0))
    order = Window.partitionBy("file").orderBy("block", "number")
    parts = ends.withColumn("group", F.coalesce(F.sum(F.when(~F.col("tail"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = parts.groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "number", "entry"))).alias("e"))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("group")))
    first = F.row_number().over(Window.partitionBy("file").orderBy("group"))
    crossing = joined.select("file", F.array_join("e.entry", "").alias("entry"), (first == 1).alias("opens"), (last == 1).alias("closes"))
    # the file's outer brackets, and the comma that the reader's last piece was given
    bare = F.col("entry")
    bare = F.when(F.col("closes"), F.regexp_replace(bare, r"(?s)[\]}]\s*,?\s*$", "")).otherwise(bare)
    bare = F.when(F.col("opens"), F.regexp_replace(bare, r"(?s)^﻿?\s*[\[{]", "")).otherwise(bare)
    every = whole.select("entry").unionByName(crossing.select(bare.alias("entry")))
    return every.filter(F.trim(F.regexp_replace("entry", r"\s+", " ")) != "")
