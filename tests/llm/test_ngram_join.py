import collections
import random
import re

import pytest

from seqloom.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return collections.Counter((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def corpus(seed, n=260):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 5, 20, 60, 120]))] for _ in range(25)]
    common = [rnd.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        if rnd.random() < 0.3:
            words = common + words[:rnd.randrange(12)]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = f"u{rnd.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words) if rnd.random() < 0.9 else "\t".join(w.upper() for w in words)))
    return rows + [(5, None), (6, ""), (7, " \n "), (8, "One two"), (9, "one TWO"), (9, "one two"), (None, "three"), (None, "three four five six")]


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 1, 70)])
def test_components_match_all_pairs(spark, seed, width, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join_documents(docs, width=width, percent=percent).collect()
    assert collections.Counter(map(tuple, got)) == brute(rows, width, percent)


def test_sketch_size_cannot_change_the_result(spark):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(map(tuple, ngram_join.join_documents(docs, sketch_bits=4).collect())) == brute(rows, 3, 90)


def test_chain_of_near_copies_is_one_group(spark):
    """Neighbours link, the ends do not; the group still has one id."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(12):
        rows.append((step, " ".join(words)))
        words[step * 15] = f"n{step}"
    got = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_keep_first_keeps_one_of_each_group_and_other_columns(spark):
    rows = [(3, "a b c d e f", "x", 1), (1, "a b c d e f", "y", 2), (1, "a b c d e f", "y", 2), (2, "", "z", 3), (4, None, "z", 4), (5, "q r s t u", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, key int")
    kept = sorted((r.doc_id, r.n, r.key) for r in ngram_join.keep_first(docs).collect())
    assert kept == [(1, "y", 2), (2, "z", 3), (4, "z", 4), (5, "z", 5)]


@pytest.mark.parametrize("ids", [(None, None, None), (7, 7, 7), (None, 7, 7), (7, None, None)])
def test_keep_first_keeps_one_of_near_copies_with_null_or_repeated_ids(spark, ids):
    """Two groups of near but different texts, with the same ids in both."""
    rows = []
    for group in "ab":
        words = [f"{group}{i}" for i in range(200)]
        for i, doc_id in enumerate(ids):
            words[50 * i] = f"n{i}"
            rows.append((doc_id, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.keep_first(docs).collect()
    assert sorted(r.text.split()[1] for r in kept) == ["a1", "b1"]
    assert {r.doc_id for r in kept} == {min((i for i in ids if i is not None), default=None)}
