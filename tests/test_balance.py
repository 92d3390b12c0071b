"""Quantisers: invariants, and brute force where SQL cannot follow."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import balance, clusters, collisions, quantize, ranking, tiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    return quantize.as_doubles(rows, "vec_id", "embedding").repartition(4).cache()


@pytest.fixture(scope="module")
def points(vectors):
    rows = sorted(vectors.collect())
    return np.array([r["vec"] for r in rows])


@pytest.fixture(scope="module")
def book(points):
    return points[::63][:6].copy()


def hashes(vectors):
    from seqloom.operators.ranking import portable_hash

    return {r["item_id"]: r["h"] for r in vectors.select("item_id", portable_hash("item_id").alias("h")).collect()}


@pytest.fixture(params=["one part", "three parts"])
def any_book(spark, book, request):
    """The same codebook as one part and as several."""
    return tiles.book_of(spark, book, part_bytes=tiles.PART_BYTES if request.param == "one part" else 2 * 64 * 8)


def test_capacity_choice_equals_walk(vectors, points, book, any_book):
    caps = balance.even_capacities(len(points), len(book))
    got = {r["item_id"]: r["code"] for r in balance.capacity_assign(vectors, any_book, caps, listed=3).collect()}
    h, room, want = hashes(vectors), caps.copy(), {}
    prefs = quantize.squared_distances(points, book).argsort(1)
    for item in sorted(h, key=lambda i: (h[i], i)):
        want[item] = int(next(c for c in prefs[item] if room[c] > 0))
        room[want[item]] -= 1
    assert got == want


def test_parts_of_a_codebook(spark, vectors, points, book):
    frame = quantize.codebook_frame(spark, [book * 2, book])
    for source, level in ((book, 0), (frame, 1)):
        parts = tiles.book_of(spark, source, level, 4 * 64 * 8).parts
        assert [(p.start, p.size) for p in parts] == [(0, 4), (4, 2)]
        assert np.array_equal(np.concatenate([p.centroids.value for p in parts]), book)
    with pytest.raises(ValueError, match="codes are not"):
        tiles.book_of(spark, frame.filter("code <> 2"), 1)
    near = {r["item_id"]: r["code"] for r in tiles.nearest(vectors, tiles.book_of(spark, book, part_bytes=64 * 8)).collect()}
    assert [near[i] for i in sorted(near)] == quantize.squared_distances(points, book).argmin(1).tolist()


def test_tiles_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([[1.0, 2.0]] * 100)], ["vec"])
    for codes in (1, tiles.CELLS // 30, 2 * tiles.CELLS):
        rows = [len(x) for _, x in tiles.row_tiles([batch], codes)]
        assert sum(rows) == 100 and max(rows) * codes <= max(tiles.CELLS, codes)


def test_one_code_wanted_by_all(spark):
    """Every item likes the same code best: the rest still fill evenly."""
    v = spark.range(90).select(F.col("id").alias("item_id"), F.array(F.lit(0.0), F.lit(0.0)).alias("vec"))
    c = np.array([[0.0, 0.1], [1.0, 0.0], [2.0, 0.0]])
    out = balance.capacity_assign(v, c, balance.even_capacities(90, 3))
    assert {r["code"]: r["count"] for r in out.groupBy("code").count().collect()} == {0: 30, 1: 30, 2: 30}


def test_sinkhorn_marginals(vectors, points, book):
    caps = balance.even_capacities(len(points), len(book))
    bias = balance.sinkhorn_bias(vectors, book, caps, 0.1, iters=20)
    plan = np.exp(-quantize.squared_distances(points, book) / 0.1 + bias)
    plan /= plan.sum(1, keepdims=True)
    assert np.allclose(plan.sum(0), caps, rtol=0.05)


def test_sinkhorn_in_parts(spark, vectors, points, book):
    caps = balance.even_capacities(len(points), len(book))
    one, many = (balance.sinkhorn_bias(vectors, tiles.book_of(spark, book, part_bytes=p), caps, 0.1, iters=3) for p in (None, 2 * 64 * 8))
    assert np.allclose(one, many)


def test_temperature_is_the_exact_median(vectors, points, book, any_book):
    d = quantize.squared_distances(points, book)
    want = 0.1 * np.median(np.percentile(d - d.min(1, keepdims=True), 90, axis=1))
    assert abs(balance.temperature(vectors, any_book) - want) < 1e-12


@pytest.mark.parametrize("small", [2, 20_000])
def test_selection_of_values(spark, small):
    rng = np.random.default_rng(small)
    for values in (np.exp(rng.standard_normal(400) * 200), np.repeat([1.0, 1.0, 2.0, -5.0], 90), np.array([7.0])):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double").repartition(3)
        n = len(values)
        ranks = sorted({0, (n - 1) // 2, n // 2, n - 1})
        assert ranking.values_at(df, "x", lambda _: ranks, small=small) == [float(x) for x in np.sort(values)[ranks]]
    assert ranking.values_at(spark.createDataFrame([], "x double"), "x", lambda n: [0]) == []


def least_cost(d):
    """Total of the cheapest one-to-one assignment of rows to columns (shortest augmenting paths)."""
    n, m = d.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        reach, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            done[j0] = True
            free = ~done[1:]
            now = d[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (now < reach[1:])
            reach[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.where(free, reach[1:], np.inf).argmin()) + 1
            delta = reach[j1]
            u[match[done]] += delta
            v[done] -= delta
            reach[~done] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return sum(d[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j])


def best_within(d, lower, upper):
    """Least total over all sizes within the bounds."""
    n, k = d.shape
    sizes = (s for s in itertools.product(range(lower, upper + 1), repeat=k) if sum(s) == n)
    return min(least_cost(np.repeat(d, s, axis=1)) for s in sizes)


def points_frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "item_id bigint, vec array<double>").repartition(3)


@pytest.mark.parametrize(("n", "k", "slack", "listed", "part"), [(40, 4, 1, 32, 1 << 20), (45, 5, 0, 4, 1 << 20), (30, 3, 1, 3, 2 * 8 * 2)])
def test_auction_is_near_the_optimum(spark, n, k, slack, listed, part):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(0, 0.3, (n - n // 4, 2)), rng.normal(3, 1, (n // 4, 2))])  # one crowd wants one code
    c = np.array([[0.0, 0.0], [2.0, 2.0], [4.0, 3.0], [-1.0, 3.0], [3.0, -1.0]])[:k]
    lower, upper = n // k - slack, n // k + slack
    assigned, _ = clusters.auction(points_frame(spark, x), tiles.book_of(spark, c, part_bytes=part), lower, upper, listed=listed)
    code = {r["item_id"]: r["code"] for r in assigned.collect()}
    sizes = collections.Counter(code.values())
    assert sorted(code) == list(range(n)) and all(lower <= sizes[j] <= upper for j in range(k))
    d = ((x[:, None] - c) ** 2).sum(2)
    total, best = sum(d[i, code[i]] for i in range(n)), best_within(d, lower, upper)
    assert best <= total + 1e-9 <= best * 1.01 + 1e-9


def test_auction_of_equal_items(spark):
    """Ninety items at one place: bids tie everywhere, sizes still hold."""
    assigned, _ = clusters.auction(points_frame(spark, np.zeros((90, 2))), np.array([[0.0, 0.1], [1.0, 0.0], [2.0, 0.0]]), 29, 31)
    sizes = collections.Counter(r["code"] for r in assigned.collect())
    assert sum(sizes.values()) == 90 and all(29 <= sizes[c] <= 31 for c in range(3))


def crowded(n, k):
    """Items of which a third want one code, and the codes."""
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(0, 0.3, (n // 3, 2)), rng.normal(1, 1, (n - n // 3, 2))])
    return x, rng.normal(0.5, 1, (k, 2))


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_end_of_an_auction_takes_few_jobs(spark, monkeypatch):
    """Rounds on the driver give what rounds of Spark give; before, they went back to Spark after 64 bids a code."""
    x, c = crowded(3000, 4)
    vectors, found, jobs = points_frame(spark, x).cache(), [], []
    for i, bids in enumerate((clusters.KNOWN_BIDS, 0)):
        monkeypatch.setattr(clusters, "KNOWN_BIDS", bids)
        (assigned, prices), count = jobs_of(spark, f"auction {i}", lambda: clusters.auction(vectors, c, 749, 751))
        found.append((sorted(map(tuple, assigned.collect())), prices.tolist()))
        jobs.append(count)
    assert found[0] == found[1]
    assert jobs[0] < 0.6 * jobs[1]


@pytest.mark.parametrize("small", [0, 20_000])
def test_cuts_of_all_codes_at_once(spark, monkeypatch, small):
    """Cuts, marks and counts against sorted lists: crowded, tied, and identical offers, codes that keep all."""
    monkeypatch.setattr(clusters, "DRIVER_ROWS", small)
    monkeypatch.setattr(clusters, "TAIL_DEPTH", 3)
    monkeypatch.setattr(clusters, "KNOWN_BIDS", 0)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1 << 60)), 0, int(rng.integers(1 << 38))) for i in range(400)]
    rows += [(1000 + i, int(rng.integers(1 << 60)), 1, 77) for i in range(300)]  # one bid
    rows += [(2000 + i % 5, 9 + i % 5, 2, 5) for i in range(100)]  # few items, many times
    rows += [(3000 + i, i, 3, 8 + i) for i in range(4)]  # all kept
    offers = spark.createDataFrame(rows, "item_id bigint, h bigint, code int, bid bigint").repartition(3)
    keys = [sorted((r[3], r[1], r[0]) for r in rows if r[2] == code) for code in range(4)]
    sizes = np.array([150, 40, 70, 9])
    cuts, marks, counts = clusters._cuts(offers, {c: (len(k), k[0][0], k[-1][0]) for c, k in enumerate(keys)}, sizes)
    for code, (key, size) in enumerate(zip(keys, sizes, strict=True)):
        over = max(len(key) - size, 0)
        assert tuple(cuts[:, code]) == (key[over] if over else (-1, -1, -1))
        assert tuple(marks[:, code]) == (key[over + 4] if over + 5 < len(key) else (clusters.FAR,) * 3)
        assert counts[code] == (sum(k >= key[over] for k in key) if over else len(key))


def test_balanced_kmeans_converges_within_bounds(spark, vectors, points):
    n, k = len(points), 7
    centroids, assigned, error = clusters.balanced_kmeans(vectors, k)
    code = {r["item_id"]: r["code"] for r in assigned.collect()}
    codes = np.array([code[i] for i in sorted(code)])
    sizes = np.bincount(codes, minlength=k)
    assert max(1, n // k - 1) <= sizes.min() and sizes.max() <= n // k + 1
    assert abs(((points - centroids[codes]) ** 2).sum() - error) < 1e-6 * error
    # a fixed point up to the tolerance: the means of the clusters hardly improve it, and a plain fit is not far below
    means = np.array([points[codes == c].mean(0) for c in range(k)])
    assert ((points - means[codes]) ** 2).sum() >= error * (1 - 1e-3)
    plain = ((points[:, None] - centroids) ** 2).sum(2).min(1).sum()
    assert plain <= error <= 1.5 * plain


def test_fit_lowers_error_and_encodes_in_range(vectors):
    books, codes = quantize.fit_residual_kmeans(vectors, 8, 3, max_iter=10)
    errors = sorted(map(tuple, quantize.level_errors(vectors, codes, books).select("level", "mse_before", "mse_after").collect()))
    assert [e[0] for e in errors] == [0, 1, 2]
    assert all(after <= before for _, before, after in errors)
    assert all(abs(errors[i][2] - errors[i + 1][1]) < 1e-12 for i in range(2))
    assert {len(r["codes"]) for r in codes.collect()} == {3}
    assert codes.select(F.explode("codes").alias("c")).agg(F.min("c"), F.max("c")).first()[1] < 8


def test_parts_give_what_whole_codebooks_give(vectors, book):
    frame, part = quantize.codebook_frame(vectors.sparkSession, [book, book * 0.5]), 2 * 64 * 8
    coded = quantize.encode(vectors, frame)
    assert sorted((r["item_id"], tuple(r["codes"])) for r in coded.collect()) == sorted(
        (r["item_id"], tuple(r["codes"])) for r in quantize.encode(vectors, frame, part).collect())
    near, far = ({r["item_id"]: r["vec"] for r in quantize.residuals(vectors, coded, frame, 2, p).collect()} for p in (None, part))
    assert near.keys() == far.keys() and all(np.allclose(near[k], far[k]) for k in near)
    one, many = (sorted(map(tuple, quantize.level_errors(vectors, coded, frame, part_bytes=p).collect())) for p in (None, part))
    assert np.allclose(one, many)


def test_uniform_mapping_is_even(vectors, book):
    codes = balance.uniform_mapping(vectors, quantize.codebook_frame(vectors.sparkSession, [book, book * 0.3]), iters=5)
    for level in range(2):
        sizes = [r["count"] for r in codes.groupBy(F.col("codes")[level]).count().collect()]
        assert len(sizes) == len(book) and max(sizes) - min(sizes) <= 1


def by_item(codes):
    return {r["item_id"]: tuple(r["codes"]) for r in codes.collect()}


def resolved(points, codes, books, rounds, iters, epsilon=0.003):
    """The same for one path after the other, with scalings of rows and columns in turn."""
    tail = {i: points[i] - sum(book[c] for book, c in zip(books[:-1], code, strict=False)) for i, code in codes.items()}
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for i in sorted(codes):
            groups[codes[i]].append(i)
        codes = dict(codes)
        for path, members in groups.items():
            if len(members) == 1:
                continue
            d = ((np.array([tail[i] for i in members])[:, None] - books[-1]) ** 2).sum(2)
            middle = (d.max() + d.min()) / 2
            logits = -(d - middle) / (d.max() - middle + 1e-5) / epsilon
            log_v = np.zeros(len(books[-1]))
            for _ in range(iters):
                log_u = -np.logaddexp.reduce(logits + log_v, axis=1)
                log_v = -np.logaddexp.reduce(logits + log_u[:, None], axis=0)
            for i, row, near in zip(members, logits + log_v, logits, strict=True):
                equal = np.flatnonzero(row >= row.max() - 1e-6)
                codes[i] = (*path[:-1], int(equal[near[equal].argmax()]))
    return codes


@pytest.mark.parametrize(("rounds", "iters", "slab_rows"), [(1, 50, None), (4, 50, 64), (2, 2, 7)])
def test_collisions_equal_one_path_after_the_other(vectors, points, book, rounds, iters, slab_rows):
    """Slabs of whole paths, and paths cut into pieces, against each path by itself."""
    books = [book, book * 0.3]
    frame = quantize.codebook_frame(vectors.sparkSession, books)
    coded = quantize.encode(vectors, frame)
    got = by_item(collisions.resolve_collisions(vectors, coded, frame, rounds, iters=iters, slab_rows=slab_rows))
    want = resolved(points, by_item(coded), books, rounds, iters)
    assert got == want
    assert len(set(got.values())) >= len(set(by_item(coded).values()))


def test_nothing_collides(spark, vectors):
    few = vectors.limit(2)
    frame = quantize.codebook_frame(spark, [np.array([r["vec"] for r in few.collect()])])
    coded = quantize.encode(few, frame)
    assert by_item(collisions.resolve_collisions(few, coded, frame)) == by_item(coded)


def test_masked_mean_without_tokens(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0], 1), (1, [3.0, 5.0], 1), (1, [9.0, 9.0], 0), (2, [4.0, 4.0], 0)], "i int, v array<double>, m int")
    got = {r["i"]: r["embedding"] for r in quantize.masked_mean(df, "i", "v", "m", 2).collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_caller_encoder(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "i bigint, t string")
    out = quantize.embed_texts(df, "i", "t", encoder=lambda texts: [[len(t), 1.0] for t in texts])
    assert {r["i"]: r["embedding"] for r in out.collect()} == {1: [2.0, 1.0], 2: [4.0, 1.0]}
