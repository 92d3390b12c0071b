import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seqloom.llm import packing
from seqloom.llm import words as W

PATH = packing.default_tokenizer()
TEXTS = ["", " ", "a  b", "\n x y", "a \n b", "<|endoftext|> x y", "x  y z", "a b　c", "it's  5 o'clock \t ok ", "日本語 テキスト です",
         "a​  b\x85 c", "don't.'s (foo)'ll é, ’s\n\nx\n", "a\nb\n", "x\x0by \x7f z", "word, word. Word! 12,5 x-y_z", "é, é. ü;", "tail \n", None]


def test_ids_equal_the_tokenizer():
    plain, own = Tokenizer.from_file(PATH), packing.UnitTokenizer(PATH)
    for _ in range(2):  # from the memory too
        for lo, hi, data, offsets in W.text_chunks(pa.array(TEXTS), 40):
            for text, ids in zip(TEXTS[lo:hi], own.encode_chunk(data, offsets), strict=True):
                assert list(ids) == plain.encode(text or "", add_special_tokens=False).ids, text


def test_long_texts_in_pieces(monkeypatch):
    plain, own = Tokenizer.from_file(PATH), packing.UnitTokenizer(PATH)
    monkeypatch.setattr(packing, "LONG_PIECE", 50)
    texts = [" ".join(f"w{i * i % 97}, don't {i}" for i in range(300)), "x" * 400, "é è  " * 100 + "a b c " * 40, "\n".join(["one two", "three"] * 60)]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        parts = [p.tobytes() for p in packing.long_pieces(data)]
        assert b"".join(parts) == text.encode() and all(p for p in parts)
        assert list(own.encode_chunk(data, np.array([0, len(data)]))[0]) == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("window", "n_open"), [(2048, 32), (16, 2)])
def test_every_id_lies_in_one_piece(spark, window, n_open):
    rows = [(i, (TEXTS[i % len(TEXTS)] or "") * (i % 5) + "word " * (i * 13 % 900)) for i in range(300)] + [(7, "again"), (7, "again"), (None, "x"), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    pieces = packing.pack(docs, PATH, window=window, n_open=n_open).collect()
    plain = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for d, t in rows:
        want[d, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    sequences, docs_of = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        sequences[p.sequence_id].append(p)
        docs_of[p.doc].append(p)
    for doc, parts in docs_of.items():
        wanted = {ids: n for (d, ids), n in want.items() if d == doc}
        for ids, n in wanted.items():
            for p in parts:
                if p.doc_tokens == len(ids):
                    assert tuple(np.frombuffer(p.ids, "<u4")) == ids[p.start:p.start + p.length]
            covered = collections.Counter()
            for p in parts:
                if p.doc_tokens == len(ids):
                    covered.update(range(p.start, p.start + p.length))
            assert set(covered.values()) == {n} and len(covered) == len(ids)
    full = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        size = sum(p.length for p in parts)
        assert size <= window
        full += window - size
    assert full < 0.2 * sum(p.length for p in pieces)


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four " * 3000)], "doc_id long, text string")
    pieces = packing.pack(docs, PATH)
    rows = packing.sequences(pieces).collect()
    assert sum(r.n_ids for r in rows) == pieces.groupBy().sum("length").first()[0]
    assert all(len(r.ids) == 4 * r.n_ids and r.padded == (r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else 2048) for r in rows)
