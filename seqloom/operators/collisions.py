"""Items that share a code path, spread over the last level by balanced transport inside each path.

All paths are solved in one pass. A task takes a slab of whole paths, one below the other, and iterates the row and column
scalings of all of them at once, the sums of a path's rows coming from its stretch of the slab. A path of more rows than a slab
holds is cut into pieces; its column sums are added up over the pieces between iterations, and the scalings joined back to them.
Both take the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.aggregates import path_sizes
from seqloom.operators.quantize import n_levels, residuals
from seqloom.operators.ranking import position_in_key
from seqloom.operators.tiles import CELLS, Book, book_of, matrix, squared_distances
from seqloom.session import discard, stored

# fixed values
COLLISION_EPSILON = 0.003
COLLISION_ROUNDS = 20
LEAST_SUM = 1e-300
AMPLITUDE_FLOOR = 1e-5
TIED = 1e-6  # a path of few rows gives several codes whole to one of them; among such equals the nearest is taken


def centred_logits(d: np.ndarray, lo: np.ndarray, hi: np.ndarray, epsilon: float) -> np.ndarray:
    """Exponents of the transport kernel from distances, centred by the path's least and largest distance."""
    middle = (hi + lo) / 2
    return -(d - middle[:, None]) / (hi - middle + AMPLITUDE_FLOOR)[:, None] / epsilon


def scaled_rows(logits: np.ndarray, log_v: np.ndarray) -> np.ndarray:
    """Entries of the plan with every row summing to one."""
    m = logits + log_v
    plan = np.exp(m - m.max(1, keepdims=True))
    return plan / plan.sum(1, keepdims=True)


def best_codes(logits: np.ndarray, log_v: np.ndarray) -> np.ndarray:
    """Per row the code of the largest entry of the plan, the nearest among those equal up to `TIED`."""
    m = logits + log_v
    return np.where(m >= m.max(1, keepdims=True) - TIED, logits, -np.inf).argmax(1)


def choose(d: np.ndarray, starts: np.ndarray, epsilon: float, iters: int) -> np.ndarray:
    """The code of every row of a slab of whole paths, which begin at `starts`."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(d))))
    lo, hi = np.minimum.reduceat(d.min(1), starts), np.maximum.reduceat(d.max(1), starts)
    logits = centred_logits(d, lo[owner], hi[owner], epsilon)
    log_v = np.zeros((len(starts), d.shape[1]))
    for _ in range(iters):
        sums = np.add.reduceat(scaled_rows(logits, log_v[owner]), starts, axis=0)
        log_v -= np.log(np.maximum(sums, LEAST_SUM))
    return best_codes(logits, log_v[owner])


def slabs(batches, n_rows: int) -> Iterator:
    """Tables of whole paths of about `n_rows` rows, from batches sorted by path."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if held.num_rows < n_rows:
            continue
        path = held.column("path").to_numpy()
        cut = int(np.searchsorted(path, path[-1]))  # the last path may go on
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def resolve_collisions(
    vectors: DataFrame, coded: DataFrame, codebooks: DataFrame, rounds: int = COLLISION_ROUNDS,
    epsilon: float = COLLISION_EPSILON, iters: int = 50, slab_rows: int | None = None,
) -> DataFrame:
    """(item_id, codes): members of a shared path spread over the last level, until paths are unique, nothing moves or rounds end.

    Every worker holds the last level's codebook; the rows of a slab follow from its size.
    """
    spark = vectors.sparkSession
    levels = n_levels(codebooks)
    book = book_of(spark, codebooks, levels - 1)
    piece = slab_rows or max(1, CELLS // book.size)
    # the last-level residual depends on the earlier codes only, which never change here
    tail, tail_path = stored(residuals(vectors, coded, codebooks, levels - 1), "tail")
    coded, path = stored(coded.select("item_id", "codes"), "codes")
    for _ in range(rounds):
        groups, groups_path = stored(path_sizes(coded, "codes").filter(F.col("members") > 1).withColumn("path", F.monotonically_increasing_id()), "collided")
        if groups.isEmpty():
            break
        members = coded.join(groups, "codes").select("item_id", "path", "members").join(tail, "item_id")
        moved = _whole_paths(members.filter(F.col("members") <= piece), book, epsilon, iters, piece)
        if not groups.filter(F.col("members") > piece).isEmpty():
            moved = moved.unionByName(_cut_paths(members.filter(F.col("members") > piece), book, epsilon, iters, piece))
        joined = coded.join(moved, "item_id", "left")
        head = F.concat(F.slice("codes", 1, levels - 1), F.array("last"))
        renewed, old = joined.select("item_id", F.when(F.col("last").isNotNull(), head).otherwise(F.col("codes")).alias("codes"), F.col("codes").alias("old")), path
        table, path = stored(renewed, "codes")
        changed = not table.filter(F.col("codes") != F.col("old")).isEmpty()
        coded = table.select("item_id", "codes")
        for done in (old, groups_path):
            discard(spark, done)
        if not changed:  # the next round would see the same paths
            break
    discard(spark, tail_path)
    return coded


def _centroids(book: Book) -> np.ndarray:
    return np.concatenate([part.centroids.value for part in book.parts])


def _whole_paths(members: DataFrame, book: Book, epsilon: float, iters: int, n_rows: int) -> DataFrame:
    """(item_id, last) for paths that fit in a slab, all of them in one pass."""

    def solve(batches):
        import pyarrow as pa

        c = _centroids(book)
        for slab in slabs(batches, n_rows):
            path = slab.column("path").to_numpy()
            starts = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            last = choose(squared_distances(matrix(slab.column("vec").combine_chunks()), c), starts, epsilon, iters)
            yield from pa.table([slab.column("item_id"), pa.array(last.astype(np.int32))], names=["item_id", "last"]).to_batches()

    rows = members.select("path", "item_id", "vec").repartition("path").sortWithinPartitions("path", "item_id")
    return rows.mapInArrow(solve, "item_id bigint, last int")


def _cut_paths(members: DataFrame, book: Book, epsilon: float, iters: int, n_rows: int) -> DataFrame:
    """The same for paths above a slab, dealt to tasks in pieces: column sums per path and code are added up and joined back."""
    spark = members.sparkSession
    placed = position_in_key(members.select("path", "item_id", "vec"), ["path"], ["item_id"], "pos")
    rows, rows_path = stored(placed.withColumn("piece", F.expr(f"pos div {n_rows}L")).drop("pos").repartition("path", "piece"), "pieces")
    pieces, pieces_path = stored(rows.select("path", "piece").distinct(), "piece-list")

    def extremes(batches):
        import pyarrow as pa

        c = _centroids(book)
        for b in batches:
            d, path = squared_distances(matrix(b.column("vec")), c), b.column("path").to_numpy()
            for p in np.unique(path):
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([d[path == p].min()]), pa.array([d[path == p].max()])], ["path", "lo", "hi"])

    zeros = F.array_repeat(F.lit(0.0), book.size)
    bounds = rows.select("path", "vec").mapInArrow(extremes, "path bigint, lo double, hi double")
    state, path = stored(bounds.groupBy("path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("log_v", zeros), "scalings")

    def with_state(batches):
        c = _centroids(book)
        for b in batches:
            for lo in range(0, b.num_rows, max(1, CELLS // len(c))):
                part = b.slice(lo, max(1, CELLS // len(c)))
                lo_, hi = (part.column(n).to_numpy() for n in ("lo", "hi"))
                yield part, centred_logits(squared_distances(matrix(part.column("vec")), c), lo_, hi, epsilon), matrix(part.column("log_v"))

    def column_sums(batches):
        import pyarrow as pa

        for part, logits, log_v in with_state(batches):
            plan, owner = scaled_rows(logits, log_v), part.column("path").to_numpy()
            for p in np.unique(owner):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(book.size, p)), pa.array(np.arange(book.size)), pa.array(plan[owner == p].sum(0))], ["path", "code", "s"])

    def pick(batches):
        import pyarrow as pa

        for part, logits, log_v in with_state(batches):
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.array(best_codes(logits, log_v).astype(np.int32))], ["item_id", "last"])

    for _ in range(iters):
        # a path's scalings go to each of its pieces, so no join key is hot
        joined = rows.join(state.join(pieces, "path"), ["path", "piece"])
        sums = joined.select("path", "vec", "lo", "hi", "log_v").mapInArrow(column_sums, "path bigint, code bigint, s double").groupBy("path", "code").agg(F.sum("s").alias("s"))
        lists = sums.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("code", "s"))).alias("sums"))
        less = F.zip_with("log_v", "sums", lambda v, s: v - F.log(F.greatest(s["s"], F.lit(LEAST_SUM)))).alias("log_v")
        (state, path), old = stored(state.join(lists, "path").select("path", "lo", "hi", less), "scalings"), path
        discard(spark, old)
    joined = rows.join(state.join(pieces, "path"), ["path", "piece"])
    out, _ = stored(joined.select("item_id", "vec", "lo", "hi", "log_v").mapInArrow(pick, "item_id bigint, last int"), "spread")
    for done in (rows_path, pieces_path, path):
        discard(spark, done)
    return out
