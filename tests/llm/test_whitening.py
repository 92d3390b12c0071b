import collections

import numpy as np
import pytest

from seqloom.llm import whitening as wh

INF, NAN = float("inf"), float("nan")


def brute(rows, components=32):
    """Integers in plain Python, the covariance by the definition, projections by numpy."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    dims = collections.Counter(len(v) for _, v in good)
    dim = max(dims, key=lambda d: (dims[d], d))
    good = [(i, [int(np.floor(64 * np.float64(c))) + 1000000 for c in v]) for i, v in good if len(v) == dim]
    n, sums = len(good), [sum(x[k] for _, x in good) for k in range(dim)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in good]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in good], np.float64) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    return good, n, deviation, centred @ axes[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def check(got, rows, components=32):
    good, n, deviation, white, explained = brute(rows, components)
    assert len(got) == len(good) * white.shape[1]
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error <= 1e-4
    want = collections.Counter((i, d) for (i, _), d in zip(good, deviation, strict=True))
    assert collections.Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == want
    signs = {}
    once = {i: k for k, (i, _) in enumerate(good) if sum(j == i for j, _ in good) == 1}
    for r in got:
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        if r.vec_id in once:
            w = white[once[r.vec_id], r.component - 1]
            sign = signs.setdefault(r.component, np.sign(w) * np.sign(r.whitened)) if abs(w) > 1e-3 else signs.get(r.component)
            assert sign is None or abs(r.whitened * sign - w) < 1e-6 * (1 + abs(w))


def random_rows(seed, n=300, dim=9, scale=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim)) * np.logspace(0, -0.7, dim)
    return [(i, (scale * v).astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((n, dim)) @ mix)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, component int").repartition(parts)


@pytest.mark.parametrize(("seed", "dim", "scale"), [(1, 9, 1.0), (2, 40, 0.3), (3, 5, 3000.0)])
def test_equals_plain_integers(spark, seed, dim, scale):
    rows = random_rows(seed, dim=dim, scale=scale)
    check(wh.whiten(frame(spark, rows)).collect(), rows)


def test_rows_that_are_left_out(spark):
    rows = random_rows(4, dim=6)
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [NAN] * 6), (904, [INF] + [0.0] * 5), (905, [1.0, 2.0]), (None, rows[3][1]),
           (7, rows[8][1]), (7, rows[8][1])]
    got = wh.whiten(frame(spark, rows + odd)).collect()
    check(got, rows + odd)
    assert not {900, 901, 902, 903, 904, 905} & {r.vec_id for r in got} and None in {r.vec_id for r in got}


def test_constant_dimensions_and_equal_rows(spark):
    rows = [(i, [*v, 5.0, -5.0]) for i, v in random_rows(5, dim=4)]
    got = wh.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and got[0].identity_error < 1e-9 and abs(sum({r.explained for r in got}) - 1) < 1e-9
    assert wh.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(20)])).count() == 0


def test_block_sums_are_exact():
    rng = np.random.default_rng(6)
    for spread in (1, 50, 1 << 20):
        y = rng.integers(-spread, spread + 1, (500, 7))
        y[:, 2] = 3  # no planes at all
        sums, products = wh.block_sums(y)
        assert (sums == y.sum(axis=0)).all() and (products == y.T @ y).all()


def test_entries_too_large_for_exact_sums(spark):
    with pytest.raises(Exception, match="exactly"):
        wh.whiten(frame(spark, [(1, [1e9, 0.0]), (2, [0.0, 1.0])])).collect()


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(wh.op13_whiten(spark, sf).collect(), rows)
