import pytest
from pyspark.sql import functions as F

from seqloom.llm import url_filter

CASES = [
    ("http://x.example.org/es/1", "x.example.org", "/es/1", "example.org/es/", "block"),
    ("https://Example.ORG/en/12?q#f", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://a.b.com/fr/casino", "a.b.com", "/fr/casino", "com/fr/", "allow"),
    ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    ("http://casino-win.example.net/", "casino-win.example.net", "/", None, "block"),
    ("http://casinos.example.net/", "casinos.example.net", "/", None, "allow"),
    ("http://a.net/free/stuff", "a.net", "/free/stuff", None, "allow"),
    ("http://a.net/free-free", "a.net", "/free-free", None, "allow"),
    ("http://a.net/FREE_bets", "a.net", "/FREE_bets", None, "block"),
    ("no scheme casino", "", "", None, "block"),
    ("x://", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("a://h?x/y://z", "h", "", None, "allow"), ("http://h#/p", "h", "", None, "allow"),
]


@pytest.mark.parametrize("repeats", [1, 2])
def test_cases(spark, repeats):
    rows = [(i, c[0], "block") for i, c in enumerate(CASES)] * repeats
    urls = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = url_filter.filter_urls(urls).select("page_id", *[F.col(f"_u_{c}") for c in ("host", "path", "rule", "verdict")]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[1:]) == CASES[r.page_id][1:]


def test_vocabulary_counts_different_terms_with_boundaries():
    v = url_filter.Vocabulary(["bad", "badly"], ["free", "fre"])
    assert v.count("bad/badly.free") == (2, 1)
    assert v.count("bad1 xbad badly-") == (1, 0)
    assert v.count("free free fre") == (0, 2)
    assert v.count("") == (0, 0)
