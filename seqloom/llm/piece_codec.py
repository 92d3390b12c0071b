"""Encoding and decoding texts with a SentencePiece model through a table of distinct chunks.

In a model whose pieces never hold a whitespace marker behind another character, no merge crosses from a word to the next
marker. A text, its spaces written as markers and one put in front, therefore falls into marked words that can be segmented
apart. Characters that only byte pieces can spell (the line feed here) part words as well. Every distinct chunk is segmented
and decoded by the library once per table; ids and texts are joined back in the order of the chunks. A table belongs to one
Python worker and starts anew when it holds `TABLE_BYTES`; long texts go through in stretches that end between chunks, so
memory is a stretch and a table, whatever the texts. Only a chunk without any space or line feed is held whole.

Defined results. Null or empty text: no ids, the empty text. A marker character in a text counts as a space, as it does in
the library. Repeated rows and ids: every row is encoded. Null ids stay null. Empty table: no rows. Other columns are not
part of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seqloom.llm import words as W

TABLE_BYTES, LONG_CHUNK, STRETCH, ROWS = 96 << 20, 512, 1 << 18, 2000
MARKER = "▁"  # fixed value: the library's sign for a space
_CHUNK = re.compile(r" +[^ \n]*|\n+[^ \n]*")
_BORDER = re.compile(r"(?<=[^ \n])[ \n]")
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                       T.StructField("decoded_sha256", T.StringType())])


def stretches(text: str, limit: int = STRETCH) -> Iterator[str]:
    """The marked text cut between chunks into parts of about `limit` characters; every part starts with a chunk."""
    text = " " + text
    start = 0
    while start < len(text):
        border = _BORDER.search(text, start + limit) if start + limit < len(text) else None
        end = border.start() if border else len(text)
        yield text[start:end]
        start = end


class ChunkTable:
    """Ids, as decimals between commas, and decoded texts of the chunks seen so far."""

    def __init__(self, path: str, limit: int = TABLE_BYTES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARKER in p.lstrip(MARKER) or "\n" in p for p in pieces):
            raise ValueError("pieces of this model cross the borders of marked words")
        if self.model.normalize(" ﬁ  é\n") != f"{MARKER}{MARKER}ﬁ{MARKER}{MARKER}é\n":
            raise ValueError("this model rewrites texts before it segments them")
        self.lone = str(self.model.piece_to_id(MARKER)).encode()
        self.piece_bytes = np.array([1 if self.model.is_byte(i) else len(p.replace(MARKER, " ").encode()) for i, p in enumerate(pieces)])
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.other: dict[str, str] = {}  # decoded texts that are not the chunk itself
        self.held = 0

    def _segment(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks by the library, which puts the first marker in front by itself.

        Chunks that do not end in a space are handed over one behind the other, as no piece crosses from one to the next; the
        lengths of the pieces tell where each chunk's ids end.
        """
        together = [c for c in chunks if c[-1] != " "]
        joined = "".join(together)
        text = joined[1:] if joined[:1] == " " else joined
        ids = self.model.encode(text)
        own = ids if joined[:1] == " " else ids[1:]  # a chunk that starts with a line feed has no marker of its own
        sizes = np.cumsum(self.piece_bytes[own])
        ends = np.cumsum([len(c.encode()) for c in together], dtype=np.int64)
        if not together or sizes[-1] != ends[-1] or self.model.decode(ids) != text:
            return self._one_by_one(chunks)
        names = list(map(str, own))
        cuts = (np.searchsorted(sizes, ends) + 1).tolist()
        found = {c: ",".join(names[lo:hi]).encode() for c, lo, hi in zip(together, [0, *cuts], cuts, strict=False)}
        return found if len(together) == len(chunks) else found | self._one_by_one([c for c in chunks if c[-1] == " "])

    def _one_by_one(self, chunks: list[str]) -> dict[str, bytes]:
        found = {}
        lists = self.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for chunk, ids, text in zip(chunks, lists, self.model.decode(lists), strict=True):
            if chunk == " ":
                found[chunk] = self.lone
                continue
            found[chunk] = ",".join(map(str, ids if chunk[0] == " " else ids[1:])).encode()
            back = " " + text if chunk[0] == " " else text
            if back != chunk:
                self.other[chunk] = back
                self.held += 4 * len(chunk)
        return found

    def lookup(self, chunks: list[str]) -> dict[str, bytes]:
        """A mapping that has the ids of all `chunks`; very long chunks are not kept."""
        new = {c for c in chunks if c not in self.ids}
        if not new:
            return self.ids
        if self.held > self.limit:
            self._clear()
            new = set(chunks)
        found = self._segment(list(new))
        kept = {c: ids for c, ids in found.items() if len(c) <= LONG_CHUNK}
        self.held += sum(2 * len(c) + len(ids) + 150 for c, ids in kept.items())
        self.ids.update(kept)
        return self.ids if len(kept) == len(found) else {**{c: self.ids[c] for c in chunks if c in self.ids}, **found}

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, hash of the ids and hash of the decoded text."""
        ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        text = (text or "").replace(MARKER, " ")
        for part in stretches(text) if text else ():
            chunks = _CHUNK.findall(part)
            joined = b",".join(map(self.lookup(chunks).__getitem__, chunks))
            back = part
            if self.other and not self.other.keys().isdisjoint(chunks):
                back = "".join(self.other.get(c, c) for c in chunks)
            ids_hash.update(b"," + joined if n else joined)
            text_hash.update((back if n else back[1:]).encode())  # the marker put in front is taken away again
            n += joined.count(b",") + 1
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text."""
        out: list[int] = []
        text = (text or "").replace(MARKER, " ")
        for part in stretches(text) if text else ():
            chunks = _CHUNK.findall(part)
            out += map(int, b",".join(map(self.lookup(chunks).__getitem__, chunks)).split(b","))
        return out


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """One table per Python worker and model."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array) of every text."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_path)
        for batch in batches:
            for lo, hi, _, _ in W.text_chunks(W.arrow_column(batch, text_col)):
                part = batch.slice(lo, hi - lo)
                ids = [table.encode(t.as_py()) for t in W.arrow_column(part, text_col)]
                yield pa.RecordBatch.from_arrays([W.arrow_column(part, id_col), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return W.map_arrow(docs.select(id_col, text_col), run, schema).withColumnRenamed("id", id_col)


def codec_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, then decoded again."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *RESULT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                rows = [table.digest(t.as_py()) for t in W.arrow_column(part, text_col)]
                n, ids, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([W.arrow_column(part, id_col), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)],
                                                 names=[f.name for f in schema])

    return W.map_arrow(docs.select(id_col, text_col), run, schema).withColumnRenamed("id", id_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    return codec_digests(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), default_model())


QUERIES = {"op12_piece_codec": op12_piece_codec}
ORACLES: dict[str, str] = {}
