"""Hot keys: a third of all rows on one key must give the same result as the plain path."""

import collections

import pytest
from pyspark.sql import functions as F

from seqloom.operators import aggregates, core, ranking, sampling, sequences
from seqloom.operators.candidates import log_softmax
from seqloom.operators.rewards import select_completions


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows, user 0 holds a third of them, times repeat."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).cast("bigint").alias("u"),
        (F.col("id") * 7 % 50).alias("i"), (F.col("id") * 13 % 400).alias("ts"), F.col("id").alias("event"))


def rows_by_user(df):
    users = collections.defaultdict(list)
    for r in df.collect():
        users[r["u"]].append((r["ts"], r["event"], r["i"]))
    return {u: sorted(v) for u, v in users.items()}


def test_windows_on_hot_user(hot):
    got = {r["event"]: [h["i"] for h in r["history"]] for r in sequences.sliding_windows(
        hot, "u", ["ts", "event"], ["i"], width=10, heavy_rows=200, slice_rows=64).collect()}
    want = {}
    for rows in rows_by_user(hot).values():
        for n in range(1, len(rows)):
            want[rows[n][1]] = [i for _, _, i in rows[max(n - 10, 0):n]]
    assert got == want


def test_sequences_on_hot_user(hot):
    out = sequences.user_sequences(hot, "u", ["ts", "event"], ["i"], heavy_rows=200, segment_rows=100).collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r["u"], r["segment"])):
        assert len(r["sequence"]) <= 100
        got[r["u"]] += [s["i"] for s in r["sequence"]]
    assert got == {u: [i for _, _, i in v] for u, v in rows_by_user(hot).items()}
    assert max(r["segment"] for r in out if r["u"] == 0) > 0


def test_short_users_are_judged_by_all_their_segments(spark):
    df = spark.range(301).select(F.lit(0).alias("u"), F.col("id").alias("ts")).union(spark.range(1).select(F.lit(1).alias("u"), "id"))
    out = sequences.user_sequences(df, "u", ["ts"], ["ts"], heavy_rows=200, segment_rows=100)
    assert [r["u"] for r in sequences.drop_short(out, "sequence", "u").collect()] == [0] * 4


def test_windows_wider_than_a_slice(spark):
    df = spark.range(60).select(F.lit(0).alias("u"), F.col("id").alias("ts"))
    got = {r["ts"]: [h["ts"] for h in r["history"]] for r in sequences.sliding_windows(df, "u", ["ts"], ["ts"], 10, heavy_rows=20, slice_rows=4).collect()}
    assert got == {n: list(range(max(0, n - 10), n)) for n in range(1, 60)}


def test_positions_agree(hot):
    plain = ranking.position_in_key(hot, ["u"], ["ts", "event"]).select("event", "pos")
    spread = ranking.position_in_key(hot, ["u"], ["ts", "event"], limit=50).select("event", "pos")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))


def test_suffixes_on_hot_path(spark):
    items = spark.range(900).select("id", F.array(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int")).alias("codes"))
    plain = aggregates.suffix_collisions(items, "id", "codes")
    spread = aggregates.suffix_collisions(items, "id", "codes", heavy_rows=40)
    a, b = ({r["id"]: tuple(r["codes"]) for r in d.collect()} for d in (plain, spread))
    assert a == b and len(set(a.values())) == 900


def test_cuts_with_ties(spark):
    tied = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 10).otherwise(F.col("id") % 41).cast("bigint").alias("ts"), F.col("id").alias("e"))
    order = sorted((r["ts"], r["e"]) for r in tied.collect())
    for small in (10, 100_000):
        n, cuts = ranking.cut_rows(tied, ["ts", "e"], lambda n: [0, n // 10, n // 2, n - 1, n], small=small)
        assert n == 5000 and cuts == [order[0], order[500], order[2500], order[4999], None]


@pytest.mark.parametrize("n", [1, 9, 10, 11])
def test_split_sizes(spark, n):
    df = spark.range(n).select(F.col("id").alias("ts"))
    counts = {r["split"]: r["count"] for r in ranking.chronological_split(df, ["ts"]).groupBy("split").count().collect()}
    train, valid = int(0.8 * n), int(0.9 * n) - int(0.8 * n)
    assert (counts.get("train", 0), counts.get("valid", 0), counts.get("test", 0)) == (train, valid, n - train - valid)


@pytest.mark.parametrize("n,shards", [(1, 3), (10, 4), (11, 5)])
def test_shards(spark, n, shards):
    rows = ranking.contiguous_shards(spark.range(n), ["id"], shards).collect()
    for r in rows:
        assert r["shard"] * n // shards <= r["row"] < (r["shard"] + 1) * n // shards


def brute_core(edges, uk, ik):
    edges = list(edges)
    while True:
        u, i = collections.Counter(e[0] for e in edges), collections.Counter(e[1] for e in edges)
        kept = [e for e in edges if u[e[0]] >= uk and i[e[1]] >= ik]
        if len(kept) == len(edges):
            return sorted(kept)
        edges = kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_core_is_order_free(spark, seed):
    import random

    rng = random.Random(seed)
    edges = [(rng.randrange(12) if rng.random() > 0.33 else 0, rng.randrange(15)) for _ in range(90)]
    df = spark.createDataFrame([(u, i, n) for n, (u, i) in enumerate(edges)], "u bigint, i bigint, n int")
    want = brute_core(edges, 4, 5)
    for items_first in (False, True):
        got = core.k_core(df, "u", "i", 4, 5, items_first=items_first)
        assert sorted((r["u"], r["i"]) for r in got.collect()) == want
        again = core.k_core(got, "u", "i", 4, 5)
        assert again.count() == len(want)


def test_core_chain_empties(spark):
    chain = spark.createDataFrame([(n, n + d) for n in range(8) for d in (0, 1)], "u bigint, i bigint")
    edges, sizes = core.core_edges(core.degree_edges(chain, "u", "i"), 2, 2)
    assert edges.count() == 0 and len(sizes) > 4


def test_samples_have_their_size(spark):
    df = spark.range(500)
    for n in (0, 1, 120, 499, 500, 900):
        assert sampling.sample_rows(df, ["id"], n).count() == min(n, 500)
    small, large = ({r["id"] for r in sampling.sample_rows(df, ["id"], n).collect()} for n in (100, 200))
    assert small < large
    assert sampling.keep_fraction(df, ["id"], 0.31).count() == 155 and sampling.skip_first_fraction(df, ["id"], 0.31).count() == 345
    assert sampling.keep_fraction(df, ["id"], 1.0).count() == 500 and sampling.skip_first_fraction(df, ["id"], 1.0).count() == 0


def test_negatives_avoid_target(spark):
    df = spark.range(400).withColumn("t", F.col("id") % 5).withColumn("neg", sampling.uniform_negative(F.col("id"), F.col("t"), 5))
    rows = df.collect()
    assert all(r["neg"] != r["t"] and 0 <= r["neg"] < 5 for r in rows) and len({r["neg"] for r in rows}) == 5


def test_log_softmax_sums_to_one(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), (F.col("id") * 900.0).alias("s"))
    sums = log_softmax(df, ["g"], "s").groupBy("g").agg(F.sum(F.exp("logp")).alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in sums)


def one_by_one(draw, target, g):
    counts = dict(sorted(collections.Counter(draw).items(), key=lambda kv: kv[1], reverse=True))
    out = [target] * min(counts.get(target, 0), g)
    while len(out) < g:
        for c in counts:
            if c != target and counts[c] > 0 and len(out) < g:
                out.append(c)
                counts[c] -= 1
    return sorted(out)


def test_selection_equals_one_by_one(spark):
    import random

    rng, rows, want = random.Random(5), [], {}
    for group in range(40):
        draw = [rng.choice("abcdef"[: rng.randrange(2, 7)]) for _ in range(12)]
        target = rng.choice("abz")
        want[group] = one_by_one(draw, target, 8)
        rows += [(group, pos, c, target) for pos, c in enumerate(draw)]
    df = spark.createDataFrame(rows, "g int, pos int, c string, t string")
    got = collections.defaultdict(list)
    for r in select_completions(df, ["g"], "pos", "c", "t", 8).collect():
        got[r["g"]].append(r["c"])
    assert {g: sorted(v) for g, v in got.items()} == want


def test_caller_reward_gets_its_columns(spark):
    from seqloom.operators.rewards import caller_reward

    df = spark.createDataFrame([("p", "abc", 2), ("q", "a", 5)], "p string, c string, w int")
    got = df.select(caller_reward(lambda prompts, completions, w: [len(c) * x for c, x in zip(completions, w)], "p", "c", "w").alias("r"))
    assert [r["r"] for r in got.collect()] == [6.0, 5.0]


def test_core_leaves_one_stored_table(spark):
    """A chain that loses one layer per round: many rounds, one table left at the end."""
    import glob

    from seqloom.session import durable_root

    root = durable_root(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/core-*"))
    chain = spark.range(12).select(F.col("id").alias("u"), F.col("id").alias("i")).union(spark.range(11).select("id", F.col("id") + 1))
    edges, sizes = core.core_edges(core.degree_edges(chain, "u", "i"), 2, 2)
    assert edges.count() == 0 and len(sizes) > 5
    assert len(set(glob.glob(f"{root}/core-*")) - before) == 1


def test_rows_without_time_come_first(spark):
    rows = [(None if i % 4 == 0 else 100 - i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "ts long, id long")
    got = {r["id"]: r["split"] for r in ranking.chronological_split(df, ["ts", "id"]).collect()}
    order = [i for _, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert got == {i: "train" if k < 32 else "valid" if k < 36 else "test" for k, i in enumerate(order)}
    late = spark.createDataFrame([(None, i) for i in range(9)] + [(5, 9)], "ts long, id long")
    assert {r["id"]: r["split"] for r in ranking.chronological_split(late, ["ts", "id"]).collect()} == {**{i: "train" for i in range(9)}, 9: "test"}


def test_segments_do_not_depend_on_the_heavy_limit(hot):
    one, other = (sorted((r["u"], r["segment"], [s["i"] for s in r["sequence"]]) for r in sequences.user_sequences(
        hot, "u", ["ts", "event"], ["i"], heavy_rows=limit, segment_rows=100).collect()) for limit in (None, 200))
    assert one == other
    whole = sequences.whole_sequences(sequences.user_sequences(hot, "u", ["ts", "event"], ["i"], segment_rows=100), "u")
    assert {r["u"]: [s["i"] for s in r["sequence"]] for r in whole.collect()} == {u: [i for _, _, i in v] for u, v in rows_by_user(hot).items()}


@pytest.mark.parametrize("name", ["user_sequences", "short_sequences_dropped", "sequence_folder", "user_sequence_file", "preference_json"])
@pytest.mark.parametrize("heavy", [3, None])
def test_sequence_queries_with_many_segments(spark, monkeypatch, name, heavy):
    """Users of several segments, as above and as below the heavy limit: one row or key each, like the SQL says."""
    from oracle import compare, duck

    from seqloom.catalog import load

    queries, oracles = load()
    monkeypatch.setattr(sequences.user_sequences, "__defaults__", (heavy, 4))
    rows, problem = compare(spark, duck("/root/testdata/sf0.001"), queries[name], oracles[name], "/root/testdata/sf0.001")
    assert rows and not problem, problem


def test_first_users_keep_all_their_segments(spark, tmp_path):
    from seqloom.sources import readers

    df = spark.range(30).select((F.col("id") % 3).alias("uid"), F.col("id").alias("item_id"))
    s = sequences.user_sequences(df, "uid", ["item_id"], ["item_id"], segment_rows=4)
    s.select("uid", "segment", F.col("sequence.item_id").alias("item_id")).write.parquet(f"{tmp_path}/s/train")
    got = sorted((r["uid"], r["segment"], len(r["item_ids"])) for r in readers.read_sequences(spark, f"{tmp_path}/s", first=2).collect())
    assert got == [(u, n, size) for u in (0, 1) for n, size in enumerate((4, 4, 2))]


def test_core_rounds_do_not_write_the_edges_anew(spark, monkeypatch):
    """A chain that loses one layer per round beside a large core: the edges are written once, whatever the number of rounds."""
    from pyspark.sql import DataFrameWriter

    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), write(self, path, *a, **k))[1])
    core_rows = [(u, i) for u in range(100, 105) for i in range(100, 105)]
    df = spark.createDataFrame([(n, n + d) for n in range(4) for d in (0, 1)] + core_rows, "u bigint, i bigint")
    got = core.k_core(df, "u", "i", 2)
    assert sorted(map(tuple, got.collect())) == core_rows
    assert len([p for p in written if "/core-" in p]) == 1


def test_core_counts_rows_without_an_item(spark):
    """A row without an item counts for its user and is not in the core; it never makes the others go."""
    df = spark.createDataFrame([(1, 1), (1, None), (2, 1), (2, 2), (None, 1), (3, 3), (4, None), (4, None)], "u bigint, i bigint")
    assert sorted(map(tuple, core.k_core(df, "u", "i", 2).collect())) == [(1, 1)]


@pytest.mark.parametrize("name,key", [("user_sequences", "uid"), ("sequence_folder", "uid"), ("user_sequence_file", "uid")])
def test_sequence_queries_give_whole_sequences(spark, name, key):
    """One row per user with all of the user's rows, also for users of more than one segment."""
    from seqloom.catalog import load

    folder = "/root/testdata/sf0.001"
    n = {r["user_id"]: r["count"] for r in spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").count().collect()}
    assert max(n.values()) > 30
    rows = load()[0][name](spark, folder).collect()
    column = "items" if "items" in rows[0] else "item_ids"
    assert sorted((r[key], len(r[column].replace(",", " ").split(" "))) for r in rows) == sorted(n.items())


@pytest.mark.parametrize("near", [None, ["u", "block"]])
def test_array_lookup_by_blocks(spark, near):
    """Ids met many times, unknown, null or repeated in the table, and rows without ids, with and without blocks."""
    from seqloom.operators import lookups

    rows = [(7, 0, 1, "a", [1, 2, 9]), (7, 0, 2, "b", [2, 9, None, 2]), (7, 1, 3, "c", []), (None, 0, 4, "d", None), (8, 0, 5, "e", [3, 1])]
    df = spark.createDataFrame(rows, "u bigint, block bigint, k bigint, note string, ids array<bigint>")
    names = spark.createDataFrame([(1, "one"), (2, "two"), (3, "x"), (3, "y")], "key bigint, name string")
    value = {"names": F.coalesce("name", F.concat(F.lit("?"), F.coalesce(F.col("__id").cast("string"), F.lit("-"))))}
    got = {(r["k"], r["u"], r["note"]): (r["ids"], r["names"]) for r in lookups.map_elements(df, ["k"], "ids", names, "key", value, True, near=near).collect()}
    assert got == {(1, 7, "a"): ([1, 2, 9], ["one", "two", "?9"]), (2, 7, "b"): ([2, 9, None, 2], ["two", "?9", "?-", "two"]),
                   (3, 7, "c"): ([], []), (4, None, "d"): ([], []), (5, 8, "e"): ([3, 3, 1], ["x", "y", "one"])}
    known = lookups.map_elements(df, ["k"], "ids", names, "key", {"names": F.col("name")}, near=near)
    assert {r["k"]: (r["ids"], r["names"]) for r in known.collect()} == {
        1: ([1, 2, 9], ["one", "two"]), 2: ([2, 9, None, 2], ["two", "two"]), 3: ([], []), 4: ([], []), 5: ([3, 3, 1], ["x", "y", "one"])}


@pytest.mark.parametrize("heavy", [3, None])
def test_rows_that_tie_share_their_position(spark, heavy):
    df = spark.createDataFrame([(1, t, n) for n, t in enumerate((5, 6, 6, 7, 8, 8, 8))] + [(2, 1, 9), (2, 2, 10)], "u bigint, ts bigint, n bigint")
    got = sequences.sliding_windows(df, "u", ["ts"], ["ts"], heavy_rows=heavy, slice_rows=10, position="place").select("u", "ts", "place")
    assert sorted(map(tuple, got.collect())) == [(1, 6, 1), (1, 6, 1), (1, 7, 3), (1, 8, 4), (1, 8, 4), (1, 8, 4), (2, 2, 1)]
