"""Chat formatting: minimum-cost repair of role sequences, then rendering.

A legal chat is an optional system turn, then user and assistant turns in alternation, ending with the assistant. Turns may be
relabelled, merged with the one before, or preceded by empty turns; dynamic programming over the automaton of legal turns finds
the cheapest way. Costs of stretches of turns combine like matrices (smallest sum over the state between), so a conversation is
solved in blocks of `block_turns`: one matrix per block, then the states between blocks, then each block by itself. A
conversation of any length is thus never gathered in one task; a part of its rendering comes from each block.

Defined results. Null or unknown role: any label, at a low cost. Null text: an empty turn. Turns with equal numbers: by role, then
text. Null turn numbers come first. Repeated rows are turns of their own. Null conversation ids: one conversation without id.
Empty table: empty result. Other columns are not part of the result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators.ranking import position_in_key

BLOCK_TURNS = 4096
# names of roles, and what a change costs
ROLE_NAMES = {"system": "s", "developer": "s", "user": "u", "human": "u", "assistant": "a", "gpt": "a", "bot": "a", "model": "a"}
LABELS, NAMES = "sua", {"s": "system", "u": "user", "a": "assistant"}
RELABEL = {"s": {"s": 0.0, "u": 1.5, "a": 3.0}, "u": {"s": 3.0, "u": 0.0, "a": 3.0}, "a": {"s": 3.5, "u": 3.0, "a": 0.0},
           "?": {"s": 1.0, "u": 0.5, "a": 0.6}}
MERGE, INSERT = 1.0, 1.25
# the automaton: state (^ before the first turn) to the labels that may follow; a chat may end after an assistant turn
FOLLOWS = {"^": "su", "s": "u", "u": "a", "a": "u"}
LAST = "a"
STATES = "^sua"
OPEN, CLOSE, JOIN = "<|{role}|>\n", "<|end|>\n", "\n"


@lru_cache(maxsize=None)
def bridge(state: str, label: str) -> str | None:
    """Labels of the fewest empty turns between `state` and a turn `label`, None when there is no way."""
    frontier, seen = [(state, "")], {state}
    while frontier:
        here, path = frontier.pop(0)
        if label in FOLLOWS[here]:
            return path
        for step in FOLLOWS[here]:
            if step not in seen:
                seen.add(step)
                frontier.append((step, path + step))
        if len(path) > len(STATES):
            return None
    return None


@lru_cache(maxsize=None)
def step(state: str, label: str) -> tuple[float, str]:
    """Cost and kind of a turn `label` after `state`: `+` merged with the one before, else the empty turns between."""
    between = bridge(state, label)
    ways = [(INSERT * len(between), between)] if between is not None else []
    if state == label:
        ways.append((MERGE, "+"))
    return min(ways, default=(math.inf, ""))


@lru_cache(maxsize=None)
def ending(state: str) -> tuple[float, str]:
    """Cost and labels of the empty turns that let a chat end after `state`."""
    if state == LAST:
        return 0.0, ""
    between = bridge(state, LAST)
    return INSERT * (len(between) + 1), between + LAST


@lru_cache(maxsize=100_000)
def best_paths(roles: str, entry: str) -> tuple[tuple[float, str], ...]:
    """For every state after the turns, the least cost from `entry` and the labels that reach it; equal costs by label order."""
    best = {entry: (0.0, "")}
    back = []
    for role in roles:
        now, came = {}, {}
        for label in LABELS:
            cost, state = min((best[p][0] + step(p, label)[0] + RELABEL[role][label], p) for p in best)
            if cost < math.inf:
                now[label], came[label] = (cost, ""), state
        back.append(came)
        best = now
    out = []
    for state in STATES:
        if state not in best:
            out.append((math.inf, ""))
            continue
        labels, at = [], state
        for came in reversed(back):
            labels.append(at)
            at = came[at]
        out.append((best[state][0], "".join(reversed(labels))))
    return tuple(out)


def through_blocks(matrices: list[list[float]]) -> tuple[str, float]:
    """States at the block borders of a conversation (before the first block to after the last) and the least total cost."""
    size = len(STATES)
    best, back = [0.0 if s == "^" else math.inf for s in STATES], []
    for m in matrices:
        came = [min(range(size), key=lambda p, q=q: (best[p] + m[p * size + q], p)) for q in range(size)]
        best = [best[came[q]] + m[came[q] * size + q] for q in range(size)]
        back.append(came)
    total, at = min((best[q] + ending(STATES[q])[0], q) for q in range(size))
    path = [at]
    for came in reversed(back):
        at = came[at]
        path.append(at)
    return "".join(STATES[i] for i in reversed(path)), total


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _matrix(roles: pd.Series) -> pd.Series:
    return roles.map(lambda r: [best_paths(r, entry)[q][0] for entry in STATES for q in range(len(STATES))])


@F.pandas_udf(T.StructType([T.StructField("states", T.StringType()), T.StructField("cost", T.DoubleType())]))
def _borders(matrices: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([through_blocks([list(m) for m in ms]) for ms in matrices], columns=["states", "cost"])


@F.pandas_udf(T.StructType([T.StructField("labels", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))]))
def _repair(roles: pd.Series, entry: pd.Series, leaves: pd.Series) -> pd.DataFrame:
    rows = []
    for r, state, last in zip(roles, entry, leaves, strict=True):
        labels = best_paths(r, state)[STATES.index(last)][1]
        rows.append((labels, [step(p, q)[1] for p, q in zip(state + labels, labels, strict=False)]))
    return pd.DataFrame(rows, columns=["labels", "kinds"])


def _header(letter: Column) -> Column:
    out = F.lit(None).cast("string")
    for short, name in NAMES.items():
        out = F.when(letter == short, F.lit(OPEN.format(role=name))).otherwise(out)
    return out


def _empties(letters: Column) -> Column:
    """Rendering of empty turns, each closed."""
    for short, name in NAMES.items():
        letters = F.replace(letters, F.lit(short.upper()), F.lit(OPEN.format(role=name) + CLOSE))
    return letters


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per conversation and block: conv, part, n_turns, n_merged, n_relabelled, n_inserted, rendered, and the conversation's cost.

    The renderings of the parts, in order, make the whole chat.
    """
    role = F.lower(F.trim(F.col(role_col)))
    letter = F.lit("?")
    for name, short in ROLE_NAMES.items():
        letter = F.when(role == name, F.lit(short)).otherwise(letter)
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |"))  # no text can look like a marker
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), letter.alias("role"), text.alias("text"),
                        F.monotonically_increasing_id().alias("row"))
    placed = position_in_key(rows, ["conv"], ["turn", "role", "text", "row"], "pos").withColumn("part", F.expr(f"pos div {block_turns}L"))
    blocks = placed.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    blocks = blocks.withColumn("roles", F.array_join(F.col("turns.role"), ""))
    solved = (blocks.select("conv", "part", _matrix("roles").alias("m")).groupBy("conv")
              .agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("ms"))
              .select("conv", F.size("ms").alias("n_parts"), _borders(F.col("ms.m")).alias("b")))
    rows = (blocks.alias("l").join(solved.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
            .withColumn("entry", F.substring("b.states", F.col("part").cast("int") + 1, F.lit(1)))
            .withColumn("leaves", F.substring("b.states", F.col("part").cast("int") + 2, F.lit(1)))
            .withColumn("fix", _repair("roles", "entry", "leaves")))
    tail = F.lit("")
    for state in LABELS:
        tail = F.when(F.col("leaves") == state, F.lit(ending(state)[1])).otherwise(tail)
    ends = F.col("part") == F.col("n_parts") - 1
    rows = rows.withColumn("tail", F.when(ends, tail).otherwise(F.lit("")))

    def piece(t, i):
        kind, label = F.get(F.col("fix.kinds"), i), F.substring("fix.labels", i + 1, F.lit(1))
        first = (F.col("part") == 0) & (i == 0)
        fresh = F.concat(F.when(first, F.lit("")).otherwise(F.lit(CLOSE)), _empties(F.upper(kind)), _header(label), t["text"])
        return F.when(kind == "+", F.concat(F.lit(JOIN), t["text"])).otherwise(fresh)

    body = F.array_join(F.transform("turns", piece), "")
    closing = F.when(ends, F.concat(F.lit(CLOSE), _empties(F.upper(F.col("tail"))))).otherwise(F.lit(""))
    n_inserted = F.aggregate(F.col("fix.kinds"), F.lit(0), lambda a, k: a + F.when(k == "+", 0).otherwise(F.length(k))) + F.length("tail")
    changed = F.filter(F.zip_with(F.split("roles", ""), F.split(F.col("fix.labels"), ""), lambda a, b: (a != b).cast("int")), lambda x: x == 1)
    return rows.select("conv", "part", F.size("turns").cast("bigint").alias("n_turns"),
                       F.size(F.filter(F.col("fix.kinds"), lambda k: k == "+")).cast("bigint").alias("n_merged"),
                       F.size(changed).cast("bigint").alias("n_relabelled"), n_inserted.cast("bigint").alias("n_inserted"),
                       F.col("b.cost").alias("cost"), F.concat(body, closing).alias("rendered"))


def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_chats(turns).withColumnRenamed("conv", "conv_id")


QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES: dict[str, str] = {}
