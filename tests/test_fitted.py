"""Queries that SQL cannot follow, on whole tables, against numpy and plain Python."""

import collections

import numpy as np
import pytest

from seqloom.catalog import codes as catalogue
from seqloom.catalog.base import ORACLES, QUERIES
from seqloom.operators import collisions, quantize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark):
    return {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def parsed(rows, column="codes"):
    return {r["item_id"]: tuple(map(int, r[column].split(","))) for r in rows}


def member_means(points, codes):
    """Squared error left when every level's centroid is the mean of what its members have left."""
    items = sorted(codes)
    left, code = np.array([points[i] for i in items]), np.array([codes[i] for i in items])
    errors = []
    for level in range(code.shape[1]):
        for c in np.unique(code[:, level]):
            own = code[:, level] == c
            left[own] -= left[own].mean(0)
        errors.append((left**2).mean())
    return errors


def test_residual_kmeans_codes(spark, points):
    rows = QUERIES["residual_kmeans_codes"](spark, SF).collect()
    codes = parsed(rows)
    assert codes.keys() == points.keys() and {len(c) for c in codes.values()} == {3}
    assert all(0 <= x < 16 for c in codes.values() for x in c)
    errors = member_means(points, codes)
    assert sorted(errors, reverse=True) == errors
    # centroids are the means of their members once the fit has converged
    assert abs(rows[0]["mse"] - errors[-1]) < 0.02 * errors[-1]


def test_balanced_kmeans_codes(spark, points):
    rows = QUERIES["balanced_kmeans_codes"](spark, SF).collect()
    codes, n, k = parsed(rows), len(points), 8
    for level in range(2):
        sizes = collections.Counter(c[level] for c in codes.values())
        assert len(sizes) == k and n // k - 1 <= min(sizes.values()) and max(sizes.values()) <= n // k + 1
    errors = member_means(points, codes)
    assert rows[0]["nearest_mse"] <= rows[0]["mse"] * 1.01 and abs(rows[0]["mse"] - errors[-1]) < 0.02 * errors[-1]


def test_collisions_resolved(spark, points):
    from test_balance import resolved

    rows = QUERIES["collisions_resolved"](spark, SF).collect()
    books = [np.array(b) for b in levels_of(catalogue.class_codebooks(spark, SF, 2))]
    want = resolved(points, parsed(rows, "before"), books, collisions.COLLISION_ROUNDS, 50)
    assert parsed(rows) == want


def levels_of(frame):
    out = collections.defaultdict(list)
    for r in sorted(frame.collect()):
        out[r["level"]].append(r["centroid"])
    return [out[level] for level in sorted(out)]


def test_sid_index(spark, points):
    rows = QUERIES["sid_index_from_vectors"](spark, SF).collect()
    assert {r["item_id"] for r in rows} == points.keys() and len({r["sid"] for r in rows}) == len(rows)
    paths = collections.Counter(tuple(c[:3]) for c in parsed(rows).values())
    for r in rows:
        code = tuple(map(int, r["codes"].split(",")))
        assert r["sid"] == "".join(f"<{'abcd'[i]}_{c}>" for i, c in enumerate(code)) and (len(code) == 4) == (paths[code[:3]] > 1)


def murmur3(data: bytes, seed: int) -> int:
    """Signed 32-bit murmur3 as Spark hashes strings."""
    def mixed(k):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        return ((k << 15 | k >> 17) & 0xFFFFFFFF) * 0x1B873593 & 0xFFFFFFFF

    h, n = seed, len(data)
    for i in range(0, n - n % 4, 4):
        h ^= mixed(int.from_bytes(data[i:i + 4], "little"))
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    if n % 4:
        h ^= mixed(int.from_bytes(data[n - n % 4:], "little"))
    h ^= n
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_text_embeddings(spark):
    import re

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["text_embeddings"](spark, SF).collect():
        want = [0] * 64
        for word in re.split(r"[ \t\n\x0b\f\r]+", texts[r["doc_id"]]):
            want[murmur3(word.encode(), 42) % 64] += 1
        assert list(map(int, r["embedding"].split(","))) == want


def test_text_embeddings_tell_length_words_and_likeness(spark):
    import re

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["text_embeddings"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = len(re.split(r"[ \t\n\x0b\f\r]+", texts[r["doc_id"]]))
        assert (r["dim"], r["words"], r["alike"]) == (64, words, True)


def test_text_embeddings_match_their_sql(spark, tmp_path):
    """All columns, the vector too, over the given texts and over empty, missing, equal and oddly spaced ones with ids that repeat or miss."""
    import duckdb
    from oracle import compare

    odd = [(1, "a bc def ghij klmno pqrstu vwxyzab 12345678 123456789"), (1, "b a"), (2, ""), (3, "\t\n"), (4, " a  b "), (5, None), (5, None),
           (None, "b a"), (None, None), (6, "x\x0by z\u00e9 \U0001f600 \u00a0 k\u0000l \u2003"), (7, "word " * 3000)]
    spark.createDataFrame(odd, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, n, files in ((SF, 200, "documents.parquet"), (str(tmp_path), len(odd), "documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/{files}'")
        assert compare(spark, con, QUERIES["text_embeddings"], ORACLES["text_embeddings"], folder) == (n, "")
    missing = [r for r in QUERIES["text_embeddings"](spark, str(tmp_path)).collect() if r["words"] is None]
    assert [(r["embedding"], r["dim"], r["alike"]) for r in missing] == [(",".join("0" * 64), 64, True)] * 3


def test_encoding_matches_numpy(spark, points):
    books = levels_of(catalogue.class_codebooks(spark, SF))
    left = np.array([points[i] for i in sorted(points)])
    for r, level in zip(quantize.level_errors(catalogue.vectors(spark, SF), quantize.encode(catalogue.vectors(spark, SF), catalogue.class_codebooks(spark, SF)),
                                              catalogue.class_codebooks(spark, SF)).orderBy("level").collect(), books, strict=True):
        book = np.array(level)
        left = left - book[((left[:, None] - book) ** 2).sum(2).argmin(1)]
        assert abs(r["mse_after"] - (left**2).mean()) < 1e-9
