import collections

import numpy as np
import pytest

from seqloom.llm import binary_dedup as bd


def brute(rows):
    """All cosines; union-find over the links."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for dim in {len(rows[i][1]) for i in good}:
        at = [i for i in good if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in at], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True):
            links[at[a]] += 1
            links[at[b]] += 1
            parent[find(at[a])] = find(at[b])
    groups = collections.defaultdict(list)
    for i, (v, _) in enumerate(rows):
        groups[find(i)].append(v)
    return collections.Counter((v, links[i], min((x for x in groups[find(i)] if x is not None), default=None)) for i, (v, _) in enumerate(rows))


def vectors(seed, n=500, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n // 10):
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(rng.integers(1, 20)):
            side = rng.standard_normal(dim)
            side -= side @ base * base
            c = rng.choice([1.0, 0.999, 0.96, 0.951, 0.949, 0.9, 0.5])
            v = c * base + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
            out.append((v * rng.choice([0.1, 1, 30])).astype(np.float32).tolist())
    return out


@pytest.mark.parametrize(("seed", "dim", "block"), [(1, 64, 1024), (2, 64, 16), (3, 300, 64), (4, 5, 1024)])
def test_links_match_all_pairs(spark, monkeypatch, seed, dim, block):
    monkeypatch.setattr(bd, "in_blocks", lambda rows, f=bd.in_blocks: f(rows, block))
    vs = vectors(seed, dim=dim)
    rows = list(enumerate(vs)) + [(9000 + i, vs[3]) for i in range(40)]
    rows += [(9500, None), (9501, []), (9502, [0.0] * dim), (9503, [float("nan")] + vs[0][1:]), (9504, [float("inf")] + vs[0][1:]),
             (9505, [None] + vs[0][1:]), (9506, [1.0, 2.0]), (9507, [2.0, 4.0]), (None, vs[5]), (7, vs[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = collections.Counter((r.vec_id, r.n_links, r.component_id) for r in bd.near_duplicates(df).collect())
    assert got == brute([(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in bd.near_duplicates(df).collect()) == brute(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((300, 64))
    x = base + 0.5 * rng.standard_normal((300, 64))
    both = np.concatenate([base, x]).astype(np.float32)
    codes = bd.Codes(both.astype(np.float64))
    true = codes.unit @ codes.unit.T
    signs = codes.bits * 2.0 - 1
    turned = codes.unit @ bd.rotation(64, 0).T
    estimate = signs @ turned.T / (np.sqrt(bd.CODE_BITS) * codes.factor[:, None])
    off = ~np.eye(len(both), dtype=bool)
    assert abs((estimate - true)[off].mean()) < 1e-3
    assert (bd.upper_bounds(codes.payloads(), 64 << 24) >= true)[off].mean() > 0.999999


def test_band_plan_keeps_misses_rare():
    for n in (10, 1000, 10**6, 10**9):
        bits, bands = bd.band_plan(n, 0.95, 1e-5)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** bands <= 1e-5 and bits <= 24
