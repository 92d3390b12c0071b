"""Balanced code assignment: temperature, Sinkhorn scalings and capacity-limited choice.

The state of every loop is one number (or one row) per code, or one narrow row per item in the shared folder. Vectors are only
scanned, a tile of rows and codes at a time, so a loop neither grows a plan nor keeps per-item state on executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.quantize import n_levels
from seqloom.operators.ranking import portable_hash, values_at
from seqloom.operators.tiles import Book, Part, as_lists, book_of, minus_centroid, over_parts, row_tiles, squared_distances
from seqloom.session import collect_small, discard, materialize, stored, stored_counted

HASH_BITS = 60
CUT_BITS = 12
LISTED_CODES = 32
# fixed values
TEMPERATURE_QUANTILE = 90
TEMPERATURE_SHARE = 0.1
TEMPERATURE_FLOOR = 1e-6


def even_capacities(n: int, k: int) -> np.ndarray:
    """n // k each, the remainder one by one to the first codes."""
    caps = np.full(k, n // k, dtype=np.int64)
    caps[: n % k] += 1
    return caps


def spreads(vectors: DataFrame, book: Book) -> DataFrame:
    """(spread): per vector the 90th percentile of its squared distances above the smallest one.

    A percentile needs the largest tenth of the distances only, so with several parts each gives its own largest ones and its
    smallest, and what they give is merged per item.
    """
    place = TEMPERATURE_QUANTILE / 100 * (book.size - 1)
    low = int(place)
    largest = book.size - low  # from position `low` to the end

    def make(_, part: Part):
        def run(batches):
            import pyarrow as pa

            c = part.centroids.value
            keep = min(largest, len(c))
            for tile, x in row_tiles(batches, len(c)):
                d = np.sort(squared_distances(x, c), axis=1)
                yield pa.RecordBatch.from_arrays([tile.column("item_id"), pa.array(d[:, 0]), as_lists(d[:, len(c) - keep:])], ["item_id", "least", "top"])

        return run

    found = over_parts(vectors.select("item_id", "vec"), book, make, "item_id bigint, least double, top array<double>")
    if len(book.parts) > 1:
        merged = found.groupBy("item_id").agg(F.min("least").alias("least"), F.sort_array(F.flatten(F.collect_list("top"))).alias("top"))
        found = merged.withColumn("top", F.slice("top", F.size("top") - largest + 1, largest))
    at, after = F.get("top", F.lit(0)), F.coalesce(F.get("top", F.lit(1)), F.get("top", F.lit(0)))
    return found.select((at + (after - at) * (place - low) - F.col("least")).alias("spread"))


def temperature(vectors: DataFrame, centroids: np.ndarray | Book) -> float:
    """A tenth of the median, over all items, of the 90th percentile of distance above the nearest code.

    The median is selected by narrowing down on it; nothing is sorted and no task holds the values.
    """
    book = book_of(vectors.sparkSession, centroids)
    table, path = stored(spreads(vectors, book), "spreads")
    middle = values_at(table, "spread", lambda n: [(n - 1) // 2, n // 2])
    discard(vectors.sparkSession, path)
    return max(sum(middle) / 2 * TEMPERATURE_SHARE, TEMPERATURE_FLOOR) if middle else TEMPERATURE_FLOOR


def sinkhorn_bias(
    vectors: DataFrame, centroids: np.ndarray | Book, capacities: np.ndarray, tau: float, iters: int = 30, tol: float = 0.0,
) -> np.ndarray:
    """Log column scalings of the transport plan between items (equal weight) and codes (capacity).

    An iteration normalises every item's row and adds up K column sums. With one part that is one pass; with several, one pass
    per part gives each item's share of its row sum, and a second one the column sums of the part. The row scalings never matter
    for an item's own ranking of codes, so they are not kept.
    """
    target = capacities / capacities.sum()
    book = book_of(vectors.sparkSession, centroids)
    bias = np.zeros(book.size)
    n = vectors.count()
    for _ in range(iters):
        sums = _column_sums(vectors, book, bias, tau) / n
        error = np.abs(np.exp(bias) * sums - target).sum()
        bias = np.log(target) - np.log(np.maximum(sums, 1e-300))
        if error < tol:
            break
    return bias


def _column_sums(vectors: DataFrame, book: Book, bias: np.ndarray, tau: float) -> np.ndarray:
    """Sums over items of exp(-distance / tau) over the item's row sum with the biases."""
    sc = vectors.sparkSession.sparkContext
    shared = sc.broadcast(book.slices(bias))
    rows = vectors.select("item_id", "vec")

    def shares(i: int, part: Part):
        """Largest entry and scaled sum of each row's part."""
        def run(batches):
            import pyarrow as pa

            for tile, x in row_tiles(batches, part.size):
                m = -squared_distances(x, part.centroids.value) / tau + shared.value[i]
                top = m.max(1)
                yield pa.RecordBatch.from_arrays([tile.column("item_id"), pa.array(top), pa.array(np.exp(m - top[:, None]).sum(1))], ["item_id", "top", "s"])

        return run

    if len(book.parts) > 1:
        parts = over_parts(rows, book, shares, "item_id bigint, top double, s double")
        tops = parts.groupBy("item_id").agg(F.max("top").alias("m"), F.collect_list(F.struct("top", "s")).alias("e"))
        total = F.aggregate("e", F.lit(0.0), lambda acc, e: acc + e["s"] * F.exp(e["top"] - F.col("m")))
        rows = materialize(rows.join(tops.select("item_id", (F.col("m") + F.log(total)).alias("norm")), "item_id"), "normed")

    def column_sums(i: int, part: Part):
        def run(batches):
            import pyarrow as pa

            sums = np.zeros(part.size)
            for tile, x in row_tiles(batches, part.size):
                logits = -squared_distances(x, part.centroids.value) / tau
                if "norm" in tile.schema.names:
                    sums += np.exp(logits - tile.column("norm").to_numpy()[:, None]).sum(0)
                else:
                    m = logits + shared.value[i]
                    plan = np.exp(logits - m.max(1, keepdims=True))
                    sums += (plan / (plan * np.exp(shared.value[i])).sum(1, keepdims=True)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.size) + part.start), pa.array(sums)], ["code", "s"])

        return run

    sums = over_parts(rows, book, column_sums, "code bigint, s double").groupBy("code").agg(F.sum("s").alias("s"))
    out = np.zeros(book.size)
    for r in collect_small(sums, book.size, "codes"):
        out[r["code"]] = r["s"]
    shared.destroy()
    return out


def capacity_assign(
    vectors: DataFrame, centroids: np.ndarray | Book, capacities: np.ndarray, bias: np.ndarray | None = None,
    tau: float = 1.0, seed: int = 42, listed: int = LISTED_CODES,
) -> DataFrame:
    """(item_id, code): items in seeded random order each take their best code that still has room.

    Instead of walking the items, every code keeps a cut-off: the last place in the random
    order it can serve. Each round all items choose their best code whose cut-off they make,
    and overfull codes lower theirs. Cut-offs only fall, and where no code is overfull the
    choice equals that of the one-by-one walk.

    Rounds read a narrow table of each item's `listed` best codes. Items turned away by all of
    them get their next best ones listed, so the result does not depend on the length.
    """
    book = book_of(vectors.sparkSession, centroids)
    bias = np.zeros(book.size) if bias is None else bias
    cuts = np.full((2, book.size), 0, np.int64)
    cuts[0] = 1 << HASH_BITS
    hashed = vectors.select("item_id", "vec", portable_hash("item_id", seed=seed).alias("h"))
    prefs = materialize(_list_codes(hashed, book, bias, tau, cuts, listed), "prefs")
    while True:
        chosen, path = stored(_first_open(prefs, cuts), "chosen")
        loads = {r["code"]: r["count"] for r in collect_small(chosen.groupBy("code").count(), book.size + 1, "codes")}
        if sum(loads.values()) > int(np.sum(capacities)):
            raise ValueError("the capacities do not add up to the number of items")
        over = {c: int(capacities[c]) for c, n in loads.items() if c is not None and n > capacities[c]}
        if None in loads:
            turned_away = chosen.filter(F.col("code").isNull()).select("item_id")
            again = _list_codes(hashed.join(turned_away, "item_id", "left_semi"), book, bias, tau, cuts, listed)
            prefs = materialize(prefs.join(turned_away, "item_id", "left_anti").unionByName(again), "prefs")
        elif not over:
            return chosen.select("item_id", "code")
        for code, h, item in _new_cuts(chosen.filter(F.col("code").isNotNull()), over) if over else []:
            cuts[:, code] = h, item
        discard(vectors.sparkSession, path)


def _first_open(prefs: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(item_id, h, code): the first listed code whose cut-off the item makes, null when none."""
    shared = prefs.sparkSession.sparkContext.broadcast(cuts.copy())  # two numbers a code

    def run(batches):
        import pyarrow as pa

        cut_h, cut_i = shared.value
        for b in batches:
            lists, h, item = b.column("prefs"), b.column("h").to_numpy(), b.column("item_id").to_numpy()
            codes = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(lists)), np.diff(ends, prepend=0))
            makes_it = (h[row] < cut_h[codes]) | ((h[row] == cut_h[codes]) & (item[row] <= cut_i[codes]))
            at = np.flatnonzero(makes_it)
            rows, first = np.unique(row[at], return_index=True)
            code = np.zeros(len(lists), np.int32)
            none = np.ones(len(lists), bool)
            code[rows], none[rows] = codes[at[first]], False
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("h"), pa.array(code, mask=none)], ["item_id", "h", "code"])

    return prefs.mapInArrow(run, "item_id bigint, h bigint, code int")


def _list_codes(hashed: DataFrame, book: Book, bias: np.ndarray, tau: float, cuts: np.ndarray, listed: int) -> DataFrame:
    """(item_id, h, prefs): each item's best codes among those it can still get, best first."""
    sc = hashed.sparkSession.sparkContext
    shared = sc.broadcast([(bias[p.start:p.start + p.size], cuts[:, p.start:p.start + p.size]) for p in book.parts])

    def make(i: int, part: Part):
        def run(batches):
            import pyarrow as pa

            log_v, (cut_h, cut_i) = shared.value[i]
            for tile, x in row_tiles(batches, part.size):
                score = -squared_distances(x, part.centroids.value) / tau + log_v
                h, item = tile.column("h").to_numpy()[:, None], tile.column("item_id").to_numpy()[:, None]
                makes_it = (h < cut_h) | ((h == cut_h) & (item <= cut_i))
                score = np.where(makes_it, score, -np.inf)
                order = np.argsort(-score, axis=1, kind="stable")[:, :listed]
                best = np.take_along_axis(score, order, axis=1)
                sizes = np.isfinite(best).sum(axis=1)
                flat = np.isfinite(best)
                entries = pa.StructArray.from_arrays([pa.array(-best[flat]), pa.array((order[flat] + part.start).astype(np.int32))], ["loss", "code"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), entries)
                yield pa.RecordBatch.from_arrays([tile.column("item_id"), tile.column("h"), lists], ["item_id", "h", "prefs"])

        return run

    found = over_parts(hashed, book, make, "item_id bigint, h bigint, prefs array<struct<loss:double,code:int>>")
    if len(book.parts) > 1:
        found = found.groupBy("item_id", "h").agg(F.slice(F.sort_array(F.flatten(F.collect_list("prefs"))), 1, listed).alias("prefs"))
    return found.select("item_id", "h", F.col("prefs.code").alias("prefs"))


def _new_cuts(chosen: DataFrame, over: dict[int, int]) -> list[tuple[int, int, int]]:
    """Per overfull code the (h, item) of its last served place, found through a histogram.

    Only the one bucket that holds the place is sorted, about 1/4096 of the code's items.
    """
    spark = chosen.sparkSession
    room = spark.createDataFrame(list(over.items()), "code int, room bigint")
    bucket = F.shiftright("h", HASH_BITS - CUT_BITS).alias("bucket")
    rows = chosen.select("code", "h", "item_id", bucket)
    counts = rows.groupBy("code", "bucket").count().join(room, "code")
    upto = F.sum("count").over(Window.partitionBy("code").orderBy("bucket"))
    edge = counts.withColumn("upto", upto).filter(
        (F.col("upto") >= F.col("room")) & (F.col("upto") - F.col("count") < F.col("room"))
    ).select("code", "bucket", (F.col("room") - F.col("upto") + F.col("count")).alias("place"))
    at = F.row_number().over(Window.partitionBy("code").orderBy("h", "item_id"))
    last = rows.join(edge, ["code", "bucket"]).withColumn("at", at).filter(F.col("at") == F.col("place"))
    found = {r["code"]: (r["h"], r["item_id"]) for r in collect_small(last, len(over), "cut-offs")}
    return [(code, *found.get(code, (-1, 0))) for code in over]


def uniform_mapping(
    vectors: DataFrame, codebooks: DataFrame, iters: int = 30, tau: float | None = None, seed: int = 42
) -> DataFrame:
    """(item_id, codes): level by level, Sinkhorn scalings then capacity-limited choice, sizes within one of each other."""
    left, path, n = stored_counted(vectors.select("item_id", "vec"), "residual")
    codes = left.select("item_id", F.array().cast("array<int>").alias("codes"))
    levels = n_levels(codebooks)
    for level in range(levels):
        book = book_of(vectors.sparkSession, codebooks, level)
        caps = even_capacities(n, book.size)
        t = tau if tau is not None else temperature(left, book)
        bias = sinkhorn_bias(left, book, caps, t, iters)
        assigned = capacity_assign(left, book, caps, bias, t, seed + level)
        codes = materialize(codes.join(assigned, "item_id").select(
            "item_id", F.concat("codes", F.array("code")).alias("codes")), "codes")
        if level < levels - 1:
            less, old = minus_centroid(left.join(assigned, "item_id"), book), path
            left, path = stored(less, "residual")
            discard(vectors.sparkSession, old)
    discard(vectors.sparkSession, path)
    return codes
