"""Every stage of the pipeline against a plain version of it, each on what its predecessor kept."""

import collections
import re

import pytest
from pyspark.sql import functions as F
from test_host_quality import plain_measures
from test_ngram_join import brute
from test_pii import plain_spans

import corpus_pipeline
from seqloom.llm import mixing, packing
from seqloom.session import materialize

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), name)
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_quality(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    for r in steps[0].collect():
        n, _, _, _, repeats = plain_measures(r.text)
        assert (r.doc_id in kept) == (n >= 20 and 100 * repeats <= 30 * n)  # no source is a bad host here


def test_near_duplicates(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {component for _, _, component in brute(rows, 5, 80)}
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(want)


def test_personal_data(steps):
    before = {r.doc_id: r.text for r in steps[2].collect()}
    after = steps[3].collect()
    assert len(after) == len(before)
    for r in after:
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(before[r.doc_id]) and not re.search(r"[A-Za-z0-9_+/-]{24}", before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_mix(steps):
    size = {r.doc_id: (r.source, len(r.text.split())) for r in steps[3].collect()}
    read = collections.Counter(r.doc_id for r in steps[4].collect())
    assert set(read) <= set(size) and max(read.values()) <= 2
    total, longest = sum(n for _, n in size.values()), max(n for _, n in size.values())
    taken = sum(size[d][1] * k for d, k in read.items())
    assert abs(taken - mixing.SHARE * total) <= longest * len({s for s, _ in size.values()})


def test_pack(steps):
    tokens = collections.Counter()
    own = packing.UnitTokenizer(packing.default_tokenizer())
    for r in steps[4].collect():
        tokens[r.doc_id] += len(own.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    pieces = collections.Counter()
    for p in steps[5].collect():
        pieces[p.doc_id] += p.length
    assert pieces == tokens


def test_odd_rows(spark):
    """Null texts and ids, repeated rows, a source of its own, columns whose names the operators use inside: every stage gives what it says."""
    good = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(6)]
    rows = [(i, t, "a", "k", 1) for i, t in enumerate(good)] + [(0, good[0], "a", "k", 1), (None, good[1], "a", "k", 2), (None, good[5] + " more", None, "k", 3),
                                                               (7, None, "a", "k", 4), (8, "", "b", "k", 5), (9, "few words", "b", "k", 6), (10, good[2] + " me@x.yz", "b", "k", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _j_key string, _p_spans int").withColumn("n_chars", F.length("text").cast("bigint"))
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(materialize(stage(spark, steps[-1], SMALL), name))
        assert steps[-1].columns == docs.columns, name
    quality, kept, clean, mixed = ([tuple(r) for r in s.select("doc_id", "text").collect()] for s in steps[1:])
    assert collections.Counter(quality) == collections.Counter((i, t) for i, t, *_ in rows if t and len(t.split()) >= 20)
    assert sorted(i for i, _ in kept) == list(range(6)) and len({t for _, t in kept}) == 6
    assert collections.Counter(clean) == collections.Counter(kept)  # the copy with an address went with its group
    assert {i for i, _ in mixed} <= set(range(6)) and max(collections.Counter(mixed).values()) <= 2
    pieces = corpus_pipeline.pack(spark, steps[-1], SMALL).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in mixed}
