"""Tries and beams against plain walks."""

import itertools
import random

import pytest

from seqloom.operators import candidates, trie


def paths_of(seed, lengths=(3,), n=60):
    rng = random.Random(seed)
    return [tuple(f"<{'abcd'[d]}_{rng.randrange(12)}>" for d in range(rng.choice(lengths))) for _ in range(n)]


@pytest.mark.parametrize("lengths", [(3,), (1, 2, 4)])
def test_trie_holds_exactly_the_paths(lengths):
    paths = paths_of(1, lengths)
    t = trie.build(paths)
    found, stack = [], [(0, ())]
    while stack:
        node, path = stack.pop()
        if t.ends[node]:
            found.append(path)
        stack += [(int(c), (*path, t.tokens[t.token[c]])) for c in range(t.first[node], t.first[node] + t.count[node])]
    assert sorted(found) == sorted(set(paths))


def beams_of(paths, scores, width, steps):
    open_ = [((), 0.0)]
    prefixes = {p[:i] for p in paths for i in range(len(p) + 1)}
    tokens = {t for p in paths for t in p}
    for step in range(steps):
        grown = [((*p, t), total + scores[step, t]) for (p, total), t in itertools.product(open_, tokens) if (*p, t) in prefixes and (step, t) in scores]
        open_ = sorted(grown, key=lambda e: (-e[1], "".join(e[0])))[:width]
    return [("".join(p), total) for p, total in open_ if p in set(paths)]


@pytest.mark.parametrize("part_paths", [1000, 12])
def test_beams_equal_plain_search(spark, part_paths):
    """One trie and several of them; ties everywhere, as scores are small whole numbers."""
    paths, rng = paths_of(2, (2, 3, 3)), random.Random(3)
    tokens = sorted({t for p in paths for t in p})
    rows, want = [], []
    for user in range(12):
        scores = {(s, t): float(rng.randrange(4)) for s in range(3) for t in tokens if rng.random() < 0.8}
        rows += [(user, s, t, v) for (s, t), v in scores.items()]
        want += [(user, sid, total, place) for place, (sid, total) in enumerate(beams_of(paths, scores, 5, 3))]
    catalogue = spark.createDataFrame([(list(p),) for p in paths], "tokens array<string>")
    scores = spark.createDataFrame([*rows, (99, 0, tokens[0], 1.0)], "uid int, step int, token string, score double")
    got = candidates.expand_beams(spark.createDataFrame([(u,) for u in range(13)], "uid int"), catalogue, "tokens", scores, "uid", 5, 3, part_paths=part_paths)
    assert sorted(map(tuple, got.select("uid", "sid", "total", "place").collect())) == sorted(want)
    assert candidates.expand_beams(spark.createDataFrame([(1,)], "uid int"), catalogue.limit(0), "tokens", scores, "uid", 5, 3).count() == 0
