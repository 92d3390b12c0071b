import random
import re

import pytest

from seqloom.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((lambda y: y - 9 if y > 9 else y)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PIECES = ["a.b@c.de", "@x.y", "a@b.c_d@e.f.g-", "x@y", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0001.2.3.255", "1.2.3.0000000000000000000000000000000000000004",
          "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "4111  1111 1111 1111", "12 34", "+1 (974) 555-3436", "+12 - ", "+1", "++49 123 456 789)",
          "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é", "日本", " ", "\n", "-", ".", "0", "79927398713", "5500005555555559 "]


def texts():
    rnd = random.Random(11)
    out = [None, "", "plain words"] + PIECES + ["9" * 20000, "1 " * 20000, "a" * 30000 + "@", "1." * 9000, "a@b" + ".c" * 9000, "+" + "1" * 9000,
           ("mail me.x@y.zz or " * 700)]
    return out + ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", "x", ","]) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    return pii.with_spans(docs).collect()


def test_base_spans_match_the_plain_patterns(rows):
    for r in rows:
        base = [(s.kind, s.start, s.end) for s in r["_p_spans"][:r["_p_n_base"]]]
        assert base == plain_spans(r.text), (r.text or "")[:200]


def test_further_kinds_need_a_checksum_or_a_telling_word(spark):
    cases = {"pay to GB82 WEST 1234 5698 7654 32 now": ["iban:7:34"], "DE89370400440532013000": ["iban:0:22"], "DE89370400440532013001": [],
             "GB82 WEST 1234 5698 7654 32 BIC ABCDEF": ["iban:0:27"], "DE89370400440532013000 EUR 50": ["iban:0:22"], "ZZ89370400440532013000": [],
             'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962";': ["secret:13:53"], "hash 04dbebab91ab85687d33eeaaf9ac699e1188f962": [],
             "password: abcdefghijklmnopqrstuvwxyz": [], "API key A1b2C3d4/E5f6G7h8+I9j0K1l2 x": ["secret:8:34"],
             "xDE89370400440532013000": [], "my SSN is 078-05-1120.": ["ssn:10:21"], "code 078-05-1120.": [], "phone: (555) 123-4567": ["tel:7:21"],
             "(555) 123-4567": [], "hotel 555-123-4567": [], "call +1 (555) 123-4567 now": ["phone:5:22"]}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in pii.with_spans(docs).collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r["_p_spans"]] == cases[r.text], r.text
        assert all(s.score >= pii.ACCEPT for s in r["_p_spans"])


def test_redaction_keeps_everything_else(spark):
    docs = spark.createDataFrame([(1, "é me@x.yz, 1.2.3.4 + 4111 1111 1111 1111!", "k"), (2, None, "k"), (3, "nothing", "k"), (3, "nothing", "k"),
                                  (4, "+1.2.3.4 55 66 77", "k")], "doc_id long, text string, kind string")
    got = sorted((r.doc_id, r.text, r.kind) for r in pii.redact(docs).collect() if r.text)
    assert got == [(1, "é [email], [ip] + [card]!", "k"), (3, "nothing", "k"), (3, "nothing", "k"), (4, "[phone]", "k")]
    assert pii.redact(docs).where("text IS NULL").count() == 1


def test_running_sums_over_block_edges(spark):
    n = 3 * pii.BLOCK + 5
    text = "a@b.cd " * n
    row = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in row["_p_spans"]] == [(7 * i, 7 * i + 6) for i in range(n)]
