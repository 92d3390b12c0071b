import collections
import random
import re

import numpy as np

from seqloom.llm import host_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def texts():
    rnd = random.Random(3)
    out = [None, "", " \n\n ", "x", "\n", "a\na\na \na", "é" * 50, "w " * 500, "a b c d e f g h " * 2, "a b c d e f g " * 3, "##\n##\n<&>|"]
    for _ in range(300):
        words = [rnd.choice(["a", "b", "çe", "日本", "x#", "long-word-here", "\n", "t\nt"]) for _ in range(rnd.choice([3, 19, 20, 21, 60, 200]))]
        if rnd.random() < 0.4:
            at = rnd.randrange(len(words))
            words += words[at:at + 15]
        out.append(rnd.choice([" ", "\t", "  "]).join(words))
    return out


def test_measures_match_plain_ones(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in host_quality.with_measures(docs).collect():
        assert [r[f"_q_{m}"] for m in host_quality.MEASURES] == plain_measures(r.text), r.text


def test_prior_strength_follows_the_spread():
    rng = np.random.default_rng(1)

    def strength(rates, n=400):
        f = rng.binomial(n, rates)
        return host_quality.prior_strength(len(rates), float(n * len(rates)), float(n * n * len(rates)), float(f.sum()), float((f * f / n).sum()))

    assert strength(np.full(200, 0.1)) > 500  # chance alone: hosts are alike
    assert 10 < strength(rng.beta(3, 27, 400)) < 60  # true strength 30
    assert host_quality.prior_strength(1, 5.0, 25.0, 0.0, 0.0) == 1e6
    assert host_quality.prior_strength(0, 0.0, 0.0, 0.0, 0.0) == 1e6


def test_bad_host_loses_only_documents_that_break_its_rule(spark):
    clean = "these are the plain words of a clean document and it goes on " * 2 + "until the end of it comes at last"
    clean = " ".join(f"{w}{i}" for i, w in enumerate(clean.split()))
    noisy = " ".join(w + " ##" for w in clean.split())
    rows = [(i, f"good{i % 20}", clean) for i in range(400)] + [(1000 + i, "bad", noisy if i < 60 else clean) for i in range(100)]
    rows += [(2000, "good1", noisy), (2001, None, noisy), (2002, None, clean), (2004, "bad", None), (2005, "bad", "too short")]
    docs = spark.createDataFrame([(*r, True, 5) for r in rows], "doc_id long, source string, text string, kept boolean, n_words int")
    got = {r.doc_id: (r["_q_base_failed"], r["_q_kept"]) for r in host_quality.judge(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (False, True) for i in range(400))
    assert all(got[1000 + i] == (False, i >= 60) for i in range(100))
    assert got[2000] == (False, True) and got[2001] == (False, True) and got[2002] == (False, True)
    assert got[2004] == (True, False) and got[2005] == (True, False)
    assert host_quality.keep_good(docs).columns == docs.columns
