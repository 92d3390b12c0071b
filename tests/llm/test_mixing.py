import collections

import pytest

from seqloom.llm import mixing


def reshared(sizes, weights, share=1.5, most=2):
    """Share by weight, cap, share the excess again, until nothing is above its cap."""
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        rest = total - sum(capped.values())
        got = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in got if got[s] > most * sizes[s]]
        if not over:
            return {**capped, **got}
        capped |= {s: most * sizes[s] for s in over}


ROWS = ([(i, "a", "w " * (i % 7 + 1), 1) for i in range(40)] + [(100 + i, "b", "x y z " * 30, 2) for i in range(60)]
        + [(200 + i, "c", "q" + " q" * i, 3) for i in range(50)] + [(300, None, "null source", 4), (301, "d", None, 5), (302, "d", "  ", 6),
           (303, "a", "twice the same", 7), (303, "a", "twice the same", 7), (None, "b", "no id here", 8)])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, source string, text string, size long")


def test_targets_follow_repeated_resharing(docs):
    rows = mixing.assign_positions(docs).collect()
    assert len(rows) == len(ROWS)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r["_mx_size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = reshared(dict(sizes), {s: [3, 1, 2][k % 3] for k, s in enumerate(order)})
    taken = collections.Counter()
    for r in rows:
        assert r["_mx_target"] == pytest.approx(want[r.source])
        assert 0 <= r["_mx_taken"] <= 2 * r["_mx_size"]
        taken[r.source] += r["_mx_taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_positions_spend_the_schedule(docs):
    """Up to any training position, each source has spent about the integral of its schedule."""
    rows = mixing.training_order(mixing.assign_positions(docs)).where("source = 'b'").collect()
    knots = mixing.SCHEDULES[1]
    assert knots == [(0.0, 1.0), (1.0, 1.0)]
    target, spent = rows[0]["_mx_target"], 0
    for r in sorted(rows, key=lambda r: r["_mx_position"]):
        assert abs(spent / target - r["_mx_position"]) < 0.02
        spent += r["_mx_words"]


@pytest.mark.parametrize("knots", [[(0.0, 1.0), (0.5, 3.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 2.0)], [(0.0, 2.0), (0.2, 0.0), (0.7, 0.0), (1.0, 4.0)]])
def test_inverse_undoes_the_integral(spark, knots):
    from pyspark.sql import functions as F

    lit = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in knots])
    rows = (spark.range(101).select((F.col("id") / 100).alias("y")).withColumn("k", lit).withColumn("area", mixing.schedule_area(F.col("k")))
            .withColumn("demand", F.col("y") * F.element_at("area", -1))
            .withColumn("t", mixing.invert_schedule(F.col("k"), F.col("area"), F.col("demand"))).collect())

    def integral(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            if t > t0:
                end = min(t, t1)
                w = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                total += (end - t0) * (w0 + w) / 2
        return total

    for r in rows:
        assert integral(r.t) == pytest.approx(r.demand, abs=1e-9)


def test_whole_documents_and_order(docs):
    rows = mixing.mix(docs, whole=True).collect()
    assert all(r["_mx_words"] == r["_mx_size"] for r in rows)
    positions = [r["_mx_position"] for r in rows]
    assert positions == sorted(positions)
    again = mixing.mix(docs.repartition(7), whole=True).collect()
    assert collections.Counter(map(tuple, ([r.doc_id, r["_mx_position"]] for r in rows))) == collections.Counter(
        map(tuple, ([r.doc_id, r["_mx_position"]] for r in again)))
