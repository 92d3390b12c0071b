"""Iterative k-core filtering over a user-item log."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.session import discard, durable_path, stored

BROADCAST_NODES = 500_000


def degree_edges(df: DataFrame, user: str, item: str) -> DataFrame:
    """Distinct (user, item) pairs with their multiplicity: bounds a hot key by its partners."""
    return df.groupBy(F.col(user).alias("u"), F.col(item).alias("i")).agg(F.count(F.lit(1)).alias("w"))


def _below(edges: DataFrame, side: str, k: int) -> DataFrame:
    return edges.groupBy(side).agg(F.sum("w").alias("d")).filter(F.col("d") < k).select(side)


def prune_round(edges: DataFrame, user_k: int, item_k: int, items_first: bool = False) -> DataFrame:
    """One pass: both sides judged on the same snapshot, or users recounted after items go."""
    kept = edges.join(_below(edges, "i", item_k), "i", "left_anti")
    users_seen = kept if items_first else edges
    return kept.join(_below(users_seen, "u", user_k), "u", "left_anti").select("u", "i", "w")


class Peeling:
    """Edges, written once, and the degrees of the nodes not yet removed.

    A node that falls below its threshold takes its edges' weights off the other side's degrees, so each edge counts at most
    once per side over all rounds, and a round moves the degrees and the edges of its own removed nodes, not the table. The core
    is the same whichever nodes go first. Null is a node that others count but that is never removed.
    """

    def __init__(self, edges: DataFrame, user_k: int, item_k: int):
        self.spark, self.k = edges.sparkSession, {"u": user_k, "i": item_k}
        self.edges, self.path = stored(edges, "core")
        self.nodes, self.paths, self.gone, self.sizes = {}, {}, {}, []
        for side in ("i", "u"):
            self._store(side, self.edges.groupBy(F.col(side).alias("n")).agg(F.sum("w").alias("d")))
        self.held = self.sizes[-1]

    def _below(self, side: str) -> Column:
        return F.col("n").isNotNull() & (F.col("d") < self.k[side])

    def _store(self, side: str, degrees: DataFrame) -> None:
        seen, path = Observation(f"degrees-{uuid.uuid4().hex[:8]}"), durable_path(self.spark, "degrees")
        degrees.observe(seen, F.count_if(self._below(side)).alias("gone"), F.sum("d").alias("left")).write.parquet(path)
        if side in self.paths:
            discard(self.spark, self.paths[side])
        self.nodes[side], self.paths[side] = self.spark.read.schema(degrees.schema).parquet(path), path
        self.gone[side] = seen.get["gone"]
        self.sizes.append(seen.get["left"] or 0)

    def _remove(self, side: str, other: str) -> None:
        below = self.nodes[side].filter(self._below(side)).select(F.col("n").alias(side))
        few = self.gone[side] <= BROADCAST_NODES
        lost = self.edges.join(F.broadcast(below) if few else below, side, "left_semi").groupBy(F.col(other).alias("m")).agg(F.sum("w").alias("l"))
        self.nodes[side], self.gone[side] = self.nodes[side].filter(~self._below(side)), 0
        kept = self.nodes[other].join(lost, F.col("n").eqNullSafe(F.col("m")), "left")
        self._store(other, kept.select("n", (F.col("d") - F.coalesce("l", F.lit(0))).alias("d")))

    def live_edges(self) -> DataFrame:
        left = self.edges
        for side in ("u", "i"):
            left = left.join(self.nodes[side].select("n"), F.col(side).eqNullSafe(F.col("n")), "left_semi")
        return left

    def run(self) -> Peeling:
        """Remove until both thresholds hold. Edges are written anew when less than half of them is left."""
        while any(self.gone.values()):
            for side, other in (("i", "u"), ("u", "i")):
                if self.gone[side]:
                    self._remove(side, other)
            if 2 * self.sizes[-1] < self.held and any(self.gone.values()):
                edges, path = stored(self.live_edges(), "core")
                discard(self.spark, self.path)
                self.edges, self.path, self.held = edges, path, self.sizes[-1]
        return self

    def raise_k(self) -> None:
        for side in self.k:
            self.k[side] += 1
            self.gone[side] = self.nodes[side].filter(self._below(side)).count()

    def items(self) -> int:
        return self.nodes["i"].filter("d > 0").count()

    def discard(self) -> None:
        for path in (self.path, *self.paths.values()):
            discard(self.spark, path)

    def rows_of(self, df: DataFrame, user: str, item: str) -> DataFrame:
        """Rows of `df` whose user and item both survive; a hot user or item is a skewed join for adaptive execution to split."""
        for side, name in (("u", user), ("i", item)):
            df = df.join(self.nodes[side].select(F.col("n").alias(name)), name, "left_semi")
        return df


def core_edges(
    edges: DataFrame, user_k: int, item_k: int, items_first: bool = False
) -> tuple[DataFrame, list[int]]:
    """(edges of the fixpoint, weights left after each step); `items_first` says which side's rounds the fixpoint is that of, and both have the same."""
    peeling = Peeling(edges, user_k, item_k).run()
    return peeling.live_edges(), peeling.sizes


def k_core(
    df: DataFrame, user: str, item: str, user_k: int = 5, item_k: int | None = None,
    items_first: bool = False, allowed_items: DataFrame | None = None,
) -> DataFrame:
    """Rows left when every user has at least `user_k` rows and every item at least `item_k`, in whichever order they go.

    `allowed_items` (one column named like `item`) is applied once, before the first round.
    """
    source = df if allowed_items is None else df.join(allowed_items, item, "left_semi")
    return Peeling(degree_edges(source, user, item), user_k, item_k or user_k).run().rows_of(source, user, item)


def adaptive_window_core(
    load: Callable[[int], DataFrame], user: str, item: str, k: int, start_year: int,
    min_items: int, floor_year: int = 1996,
) -> tuple[DataFrame | None, int]:
    """Widen the time window one year at a time until enough items survive.

    `load(year)` gives the rows from that year on. Returns (rows, year), or (None, year)
    when the start is already below the floor.
    """
    year = start_year
    while year >= floor_year:
        rows = load(year)
        peeling = Peeling(degree_edges(rows, user, item), k, k).run()
        if year <= floor_year or peeling.items() >= min_items:
            return peeling.rows_of(rows, user, item), year
        peeling.discard()
        year -= 1
    return None, year


def adaptive_k_core(
    df: DataFrame, user: str, item: str, user_k: int, item_k: int, max_items: int,
) -> tuple[DataFrame, int, int]:
    """Raise both thresholds by one until at most `max_items` items survive; each core is cut from the one before."""
    peeling = Peeling(degree_edges(df, user, item), user_k, item_k).run()
    while peeling.items() > max_items:
        peeling.raise_k()
        peeling.run()
    return peeling.rows_of(df, user, item), peeling.k["u"], peeling.k["i"]


def density(df: DataFrame, user: str, item: str) -> DataFrame:
    """Users, items, interactions and interactions / (users x items)."""
    counts = df.agg(
        F.countDistinct(user).alias("users"), F.countDistinct(item).alias("items"),
        F.count(F.lit(1)).alias("interactions"),
    )
    cells = F.col("users") * F.col("items")
    return counts.withColumn("density", F.when(cells > 0, F.col("interactions") / cells).otherwise(F.lit(0.0)))
