"""Catalogue paths as tries in flat arrays, and beams that walk them.

Paths are sorted, so that the children of a node lie one behind the other: a node needs the place of its first child, their
number, and its token. A trie is cut by first tokens into parts of at most `PART_PATHS` paths (one first token at least), each
fetched and shipped by itself. A request is one row with its scores and its open beams; a step is a pass over those rows in Arrow
batches for every part, merged per request where there are several. No step joins on prefixes.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import collect_small, stored

PART_PATHS = 200_000
BEAMS = "array<struct<part:int,node:int,total:double,text:string>>"


class Trie(NamedTuple):
    """Nodes level by level; the root is node 0."""

    first: np.ndarray  # place of the first child
    count: np.ndarray  # number of children
    token: np.ndarray  # number of the node's own token
    ends: np.ndarray  # whether a path ends here
    tokens: list[str]


def build(paths: list[tuple[str, ...]]) -> Trie:
    """The trie of distinct paths."""
    paths = sorted(set(paths))
    tokens = sorted({t for p in paths for t in p})
    number = {t: i for i, t in enumerate(tokens)}
    depth = max(map(len, paths), default=0)
    table = np.full((len(paths), depth), -1, np.int32)
    for i, p in enumerate(paths):
        table[i, :len(p)] = [number[t] for t in p]
    lengths = np.array([len(p) for p in paths], np.int64)
    first, count, token, ends = [np.zeros(1, np.int64)], [], [np.full(1, -1, np.int32)], [np.zeros(1, bool)]
    owner, n_parents, placed = np.zeros(len(paths), np.int64), 1, 1  # node of each path at the level above, within that level
    for d in range(depth):
        live = table[:, d] >= 0
        rows, parent = table[live, d], owner[live]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (parent[1:] != parent[:-1])
        node = np.cumsum(new) - 1
        children = np.bincount(parent[new], minlength=n_parents)
        first[-1] = placed + np.cumsum(children) - children
        count.append(children)
        token.append(rows[new])
        ends.append(np.bincount(node[lengths[live] == d + 1], minlength=int(new.sum())) > 0)
        owner = np.zeros(len(paths), np.int64)
        owner[live] = node
        n_parents = int(new.sum())
        placed += n_parents
        first.append(np.zeros(n_parents, np.int64))
    count.append(np.zeros(n_parents, np.int64))
    return Trie(np.concatenate(first), np.concatenate(count), np.concatenate(token), np.concatenate(ends), tokens)


def tries(spark: SparkSession, paths: DataFrame, tokens: str, part_paths: int | None = None) -> list:
    """Shipped tries of the paths in column `tokens`, by ranges of first tokens."""
    limit = part_paths or PART_PATHS
    rows, _ = stored(paths.select(F.col(tokens).alias("p")).filter(F.size("p") > 0).distinct(), "paths")
    sizes = collect_small(rows.groupBy(F.get("p", F.lit(0)).alias("t")).count(), limit, "first tokens")
    groups, held = [], 0
    for r in sorted(sizes, key=lambda r: r["t"]):
        if not groups or held + r["count"] > limit:
            groups.append([])
            held = 0
        groups[-1].append(r["t"])
        held += r["count"]
    out = []
    for group in groups:
        some = rows.filter(F.get("p", F.lit(0)).between(group[0], group[-1]))
        size = sum(r["count"] for r in sizes if group[0] <= r["t"] <= group[-1])
        out.append(spark.sparkContext.broadcast(build([tuple(r["p"]) for r in collect_small(some, size, "paths of a part")])))
    return out


def _step(part: int, shared, step: int, width: int, separator: str, first: bool):
    """A pass that grows the beams of one part by one token and keeps the best of each request."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        trie = shared.value
        names = pa.array(trie.tokens, pa.string())
        value = np.full(len(trie.tokens) + 1, np.nan)
        for batch in batches:
            scores, beams = batch.column("scores"), batch.column("beams")
            entries, score_at = scores.flatten(), np.append(0, np.cumsum(scores.value_lengths().to_numpy(zero_copy_only=False)))
            token = pc.fill_null(pc.index_in(entries.field("token"), value_set=names), -1).to_numpy()
            here = (entries.field("step").to_numpy() == step) & (token >= 0)
            gain = entries.field("score").to_numpy()
            open_, beam_at = beams.flatten(), np.append(0, np.cumsum(beams.value_lengths().to_numpy(zero_copy_only=False)))
            of, node, total, text = (open_.field(f).to_numpy(zero_copy_only=False) for f in ("part", "node", "total", "text"))
            sizes, out_node, out_total, out_text = [], [], [], []
            for r in range(batch.num_rows):
                mine = np.arange(score_at[r], score_at[r + 1])[here[score_at[r]:score_at[r + 1]]]
                value[token[mine]] = gain[mine]
                if first:
                    nodes, totals, texts = np.zeros(1, np.int64), np.zeros(1), [""]
                else:
                    own = np.arange(beam_at[r], beam_at[r + 1])[of[beam_at[r]:beam_at[r + 1]] == part]
                    nodes, totals, texts = node[own].astype(np.int64), total[own], text[own]
                count = trie.count[nodes]
                beam = np.repeat(np.arange(len(nodes)), count)
                child = np.arange(len(beam)) + np.repeat(trie.first[nodes] - (np.cumsum(count) - count), count)
                sums = totals[beam] + value[trie.token[child]]
                kept = np.flatnonzero(~np.isnan(sums))
                if len(kept) > width:  # ties at the edge stay in until their texts are compared
                    kept = kept[sums[kept] >= np.partition(sums[kept], len(kept) - width)[len(kept) - width]]
                found = []
                for k in kept.tolist():
                    name, before = trie.tokens[trie.token[child[k]]], texts[beam[k]]
                    found.append((-sums[k], before + separator + name if before else name, int(child[k])))
                found.sort()
                sizes.append(len(found[:width]))
                for t, x, c in found[:width]:
                    out_node.append(c)
                    out_total.append(-t)
                    out_text.append(x)
                value[token[mine]] = np.nan
            rows = pa.StructArray.from_arrays([pa.array(np.full(len(out_node), part, np.int32)), pa.array(out_node, pa.int32()),
                                               pa.array(out_total, pa.float64()), pa.array(out_text, pa.string())], ["part", "node", "total", "text"])
            grown = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), rows)
            yield batch.set_column(batch.schema.get_field_index("beams"), "beams", grown)

    return run


def walk(requests: DataFrame, request: str, scores: DataFrame, parts: list, width: int, steps: int, separator: str = "") -> DataFrame:
    """(request, beams) after `steps` steps: the best `width` paths of every request, by total score and then by text.

    `scores` is (request, step, token, score), each token once per request and step; tokens without a score are not taken.
    """
    entries = F.collect_list(F.struct(F.col("step").cast("int").alias("step"), "token", F.col("score").cast("double").alias("score"))).alias("scores")
    rows = scores.join(requests.select(request), request, "left_semi").groupBy(request).agg(entries)
    rows = rows.withColumn("beams", F.array().cast(BEAMS))
    for step in range(steps):
        passes = [rows.mapInArrow(_step(i, part, step, width, separator, step == 0), rows.schema) for i, part in enumerate(parts)]
        rows = reduce(DataFrame.unionByName, passes)
        if len(parts) > 1:
            best = F.array_sort(F.flatten(F.collect_list("beams")), lambda a, b: F.when(a["total"] > b["total"], -1).when(a["total"] < b["total"], 1)
                                .when(a["text"] < b["text"], -1).when(a["text"] > b["text"], 1).otherwise(0))
            rows = rows.groupBy(request).agg(F.first("scores").alias("scores"), F.slice(best, 1, width).alias("beams")).select(*rows.columns)
    return rows.select(request, "beams")


def complete(rows: DataFrame, parts: list) -> DataFrame:
    """`rows` with only those beams whose path is a whole one of the catalogue."""
    def make(i, shared):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                kept = [[b for b in beams if b["part"] != i or shared.value.ends[b["node"]]] for beams in batch.column("beams").to_pylist()]
                kind = batch.schema.field("beams").type
                yield batch.set_column(batch.schema.get_field_index("beams"), "beams", pa.array(kept, kind))
        return run

    for i, part in enumerate(parts):
        rows = rows.mapInArrow(make(i, part), rows.schema)
    return rows
