import collections
import hashlib
import random

import pytest
import sentencepiece

from seqloom.llm import piece_codec as pc

PATH = pc.default_model()
TEXTS = [None, "", " ", "  ", "a", "a ", " a", "a  b", "   a   b   ", "a\nb", "\n", "\n\n a \n", " \n ", "a\n \nb", "▁a▁ b ▁", "▁", "é é ﬁ Ａ", "日本語 テキスト です。",
         "<s> x </s><unk> <0x0A>", "\x00 a\x00\tb", "𝔘𝔫𝔦 😀😀 ok", "x" * 3000, "word " * 50, "a\r\nb c　d", "(" * 40 + " " * 40 + "z", "'s don't 12,500.00 x_y"]


@pytest.fixture(scope="module")
def plain():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(plain, text):
    ids = plain.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.decode(ids).encode()).hexdigest()


def test_equals_the_library(plain):
    table = pc.ChunkTable(PATH)
    for _ in range(2):  # from the table too
        for text in TEXTS:
            assert table.encode(text) == plain.encode(text or ""), repr(text)
            assert table.digest(text) == expected(plain, text), repr(text)


def test_random_texts_in_short_stretches(plain, monkeypatch):
    monkeypatch.setattr(pc.stretches, "__defaults__", (7,))
    rng = random.Random(5)
    table = pc.ChunkTable(PATH, limit=5000)  # starts anew again and again
    parts = [" ", "  ", "\n", "▁", "the", "qu", "é", "界", "\t", "<s>", "ing", "1", "😀", "'", "\n\n", "x" * 600]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert table.encode(text) == plain.encode(text), repr(text)
        assert table.digest(text) == expected(plain, text), repr(text)


def test_table_stays_bounded():
    table = pc.ChunkTable(PATH, limit=10_000)
    for i in range(3000):
        table.encode(f"w{i} v{i}")
    assert len(table.ids) < 200


def test_rows(spark, plain):
    rows = [(i, TEXTS[i % len(TEXTS)], "x") for i in range(60)] + [(3, "again", "y"), (3, "again", "y"), (None, "n", "z"), (9, "long " * 200_000 + "é", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = collections.Counter(map(tuple, pc.codec_digests(docs, PATH).collect()))
    assert got == collections.Counter((d, *expected(plain, t)) for d, t, _ in rows)
    ids = collections.Counter((r.doc_id, tuple(r.ids)) for r in pc.encode_texts(docs, PATH).collect())
    assert ids == collections.Counter((d, tuple(plain.encode(t or ""))) for d, t, _ in rows)


def test_query_equals_the_library_on_whole_table(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = collections.Counter(map(tuple, pc.op12_piece_codec(spark, sf).collect()))
    assert got == collections.Counter((d, *expected(plain, t)) for d, t in docs)
