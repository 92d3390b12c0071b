import collections
import random
import re

import numpy as np
import pytest

from seqloom.llm import periodic_runs as pr
from seqloom.llm import words as W


def brute(words):
    """All maximal stretches at every distance; the smallest distance of each stretch is its period."""
    out = {}
    for d in range(1, len(words) // 2 + 1):
        i = 0
        while i + d < len(words):
            if words[i] != words[i + d]:
                i += 1
                continue
            j = i
            while j + d < len(words) and words[j] == words[j + d]:
                j += 1
            if j + d - i >= max(12, 2 * d):
                out.setdefault((i, j + d), d)
            i = j
    runs = sorted(((s, e - s, d) for (s, e), d in out.items()), key=lambda r: (r[0], r[2]))
    dropped = {k for s, n, d in runs for k in range(s + d, s + n)}
    return runs, " ".join(w for k, w in enumerate(words) if k not in dropped)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made_texts(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        alphabet = rng.choice([1, 2, 3, 30])
        parts = []
        for _ in range(rng.randrange(1, 6)):
            unit = [f"w{rng.randrange(alphabet)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 31, 64, 90]))]
            parts += unit * rng.choice([1, 1, 2, 3, 12])
            parts = parts[:-rng.randrange(1, 5)] if len(parts) > 5 and rng.random() < 0.5 else parts
        out.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return out


def fibonacci(n):
    a, b = "a", "a b"
    while len(b.split()) < n:
        a, b = b, b + " " + a
    return b


def thue_morse(n):
    return " ".join("xy"[bin(i).count("1") % 2] for i in range(n))


FIXED = ["", " \n\t", "one", "a " * 11, "a " * 12, "a " * 4000, "a b " * 700 + "b " * 40, "q w e r t z " * 2, "q w e r t z " * 2 + "q", fibonacci(600), thue_morse(1500),
         ("a " * 50 + "b ") * 6, " ".join(f"x{i}" for i in range(500)) * 1 + " ", " ".join(f"x{i % 333}" for i in range(1000))]


def compare(rows, texts):
    for row, text in zip(rows, texts, strict=True):
        runs, collapsed = brute(words_of(text))
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == runs, text[:80] if text else text
        assert row["collapsed"] == collapsed and row["n_words"] == len(words_of(text))


def searched(texts, limit=W.CHUNK_BYTES):
    import pyarrow as pa

    out = []
    for _, _, data, offsets in W.text_chunks(pa.array(texts, pa.string()), limit):
        n, runs, collapsed = pr.searched_chunk(data, offsets)
        out += [dict(zip(("n_words", "runs", "collapsed"), r, strict=True)) for r in zip(n.to_pylist(), runs.to_pylist(), collapsed.to_pylist(), strict=True)]
    return out


@pytest.mark.parametrize("size", [8, 64, 128, 1024, 8192])
def test_transform_gives_exact_correlations(size):
    rng = np.random.default_rng(size)
    width = size // 4
    blocks, windows = rng.integers(0, pr.PRIME, (3, width)).astype(float), rng.integers(0, pr.PRIME, (3, size - 1)).astype(float)
    windows[1, 5:5 + width] = blocks[1]
    got = pr.squared_differences(blocks, windows)
    for r in range(3):
        for t in (0, 1, 5, size - 1 - width):
            diff = windows[r, t:t + width].astype(np.int64) - blocks[r].astype(np.int64)
            assert got[r, t] == sum(int(x) ** 2 for x in diff) % pr.PRIME
    assert got[1, 5] == 0


@pytest.mark.parametrize("limit", [300, W.CHUNK_BYTES])
def test_runs_match_direct_search(limit):
    for seed in (1, 2, 3):
        texts = made_texts(seed) + FIXED + [None]
        compare(searched(texts, limit), texts)


def test_blocks_beyond_the_largest_size(monkeypatch):
    monkeypatch.setattr(pr, "LARGEST_BLOCK", 8)
    monkeypatch.setattr(pr, "SLAB", 64)
    texts = made_texts(9, 25) + FIXED[:-4]
    compare(searched(texts), texts)


@pytest.mark.parametrize("kept_bits", [2, 5])
def test_words_with_equal_hashes(monkeypatch, kept_bits):
    """Hashes that take many words for one cost time, not right results."""
    full = W.span_hashes
    monkeypatch.setattr(W, "span_hashes", lambda *a: full(*a) & np.uint64((1 << kept_bits) - 1))
    texts = made_texts(4, 20) + ["x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11 x12 x13 x14 x15 x16 " * 2]
    compare(searched(texts), texts)


def test_rows(spark):
    texts = made_texts(5, 20) + FIXED + [None]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "z " * 30, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)
    got = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in pr.periodic_runs(docs).collect())
    assert got == collections.Counter((i, len(words_of(t)), tuple(brute(words_of(t))[0]), brute(words_of(t))[1]) for i, t, _ in rows)


def test_planted_periods(spark):
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(300)] + [(None, "a b"), (10, None), (4, "")]
    for r, (i, t) in zip(pr.with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect(), rows, strict=True):
        words, h = words_of(t), zlib.crc32(str(i).encode())
        n = len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        assert words_of(r.text) == words


def test_one_long_text():
    """A text of many megabytes: a long period, and one word for all of it."""
    unit = " ".join(f"v{i * i % 70001}" for i in range(70000))
    rows = searched([unit + " " + unit + " v0 v1", "same " * 300_000])
    assert [tuple(r.values()) for r in rows[1]["runs"]] == [(0, 300_000, 1)] and rows[1]["collapsed"] == "same"
    assert (0, 140_002, 70000) in [tuple(r.values()) for r in rows[0]["runs"]]
