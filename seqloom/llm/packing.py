"""Packing documents into token windows with bounded space.

Each task tokenizes its documents and keeps at most `n_open` windows. A document's full windows leave at once; its rest goes
into the open window it fits most tightly. When none fits, the fullest leaves and a new one opens. What stays open at the
end of a task is merged: a few tasks read those windows in a fixed order and cut them freely, so only the last window of a
merging task can have padding. Memory is `n_open` windows and about a megabyte of text, whatever the input.

Defined results. Null or empty text: only the end id. Repeated rows and ids: every row is packed. Empty table: no pieces.
Null ids stay null. Other columns are not part of the result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import words as W
from seqloom.session import materialize

WINDOW, END_ID, N_OPEN, PARTS_PER_MERGE = 2048, 1, 32, 256
CACHE_UNITS, LONG_PIECE = 600_000, 1 << 20
PIECE_COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_BYTE = np.arange(256)
_ALNUM = ((_BYTE >= 48) & (_BYTE < 58)) | ((_BYTE >= 65) & (_BYTE < 91)) | ((_BYTE >= 97) & (_BYTE < 123))
_VISIBLE = (_BYTE > 32) & (_BYTE != 127)
_PUNCT = _VISIBLE & (_BYTE < 127) & ~_ALNUM & (_BYTE != ord("'"))
# first two UTF-8 bytes of the blocks that hold blanks outside ASCII
_WIDE_BLANKS = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE1, 0xA0), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80), (0xEF, 0xBB)]


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a text may be cut without changing the ids of its parts: always ends of pre-tokens.

    Before a single blank and around a single line feed between visible characters, and between letters or digits and
    punctuation other than the apostrophe.
    """
    cut = np.zeros(len(data), bool)
    visible, alnum, punct = _VISIBLE[data], _ALNUM[data], _PUNCT[data]
    between = np.zeros(len(data), bool)
    between[1:-1] = visible[:-2] & visible[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    between[edges] = between[edges - 1] = False
    feed = between & (data == 10)
    cut |= (between & (data == 32)) | feed
    cut[1:] |= feed[:-1] | (alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:])
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def long_pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text cut before single blanks between visible characters into pieces of about `LONG_PIECE` bytes."""
    lo = 0
    while len(data) - lo > LONG_PIECE:
        for at in range(lo + LONG_PIECE, len(data) - 1, LONG_PIECE):
            part = data[at - 1:at + LONG_PIECE + 1]
            cuts = np.flatnonzero((part[1:-1] == 32) & _VISIBLE[part[:-2]] & _VISIBLE[part[2:]])
            if len(cuts):
                yield data[lo:at + int(cuts[0])]
                lo = at + int(cuts[0])
                break
        else:
            break
    yield data[lo:]


class UnitTokenizer:
    """Ids of texts through a bounded memory of the ids of their units, the stretches between safe cuts.

    The ids equal `encode(text, add_special_tokens=False)` of the tokenizer, which sees every unit once per memory. Texts
    with blanks outside ASCII or with a special token's name go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.id_bytes[i] = len(token)  # one character of the vocabulary stands for one byte
        self._reset()

    def _reset(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted unit hashes, their places below
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Tokenize new units; those that start with a blank in one go, since a blank always starts a pre-token."""
        spaced = np.array([u[:1] == b" " and len(u) > 1 and _VISIBLE[u[1]] and _VISIBLE[u[-1]] for u in units])
        together = [units[i] for i in np.flatnonzero(spaced)]
        sizes = np.zeros(len(units), np.int64)
        found = []
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        if together:
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(together).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum([len(u) for u in together])) + 1
            sizes[spaced] = np.diff(ends, prepend=0)
            found.append(ids)
        alone = [units[i].decode() for i in np.flatnonzero(~spaced)]
        if alone:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            sizes[~spaced] = [len(x) for x in lists]
            found.append(np.array([i for x in lists for i in x], np.uint32))
        begin = np.zeros(len(units), np.int64)
        begin[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        slots = len(self.begin) + np.arange(len(units))
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, *found])
        keys, slots = np.concatenate([self.keys, hashes]), np.concatenate([self.slots, slots])
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[by_key], slots[by_key]

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        unique, first, place = np.unique(W.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_UNITS:
            self._reset()
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = self.keys[at] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            raw = data.tobytes()
            self._learn(unique[new], [raw[a:b] for a, b in zip(starts[first[new]], ends[first[new]], strict=True)])
            at = np.searchsorted(self.keys, unique)
        slots = self.slots[at][place]
        sizes = self.size[slots]
        stops = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.begin[slots] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        return ids, np.append(0, stops)[np.searchsorted(starts, offsets)]

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of every text of a chunk of UTF-8 bytes."""
        odd = set()
        for a, b in _WIDE_BLANKS:
            hits = np.flatnonzero((data[:-1] == a) & (data[1:] == b))
            odd.update((np.searchsorted(offsets, hits, "right") - 1).tolist())
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            odd.update(i for i in range(len(offsets) - 1) if any(s in raw[offsets[i]:offsets[i + 1]] for s in self.special))
        if len(offsets) == 2 and len(data) > LONG_PIECE and not odd:
            return [np.concatenate([self._units(part, np.array([0, len(part)]))[0] for part in long_pieces(data)])]
        ids, at = self._units(data, offsets) if len(odd) < len(offsets) - 1 and len(data) else (None, None)
        empty = np.zeros(0, np.uint32)
        return [np.array(self.tokenizer.encode(raw[offsets[i]:offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                if i in odd else ids[at[i]:at[i + 1]] if ids is not None else empty for i in range(len(offsets) - 1)]


_TOKENIZERS: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    """One tokenizer per Python worker."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        _TOKENIZERS[path] = UnitTokenizer(path)
    return _TOKENIZERS[path]


class Packer:
    """Rows of pieces for windows that leave; `close` gives the pieces of those still open."""

    def __init__(self, first_sequence: int, window: int, n_open: int, keep_ids: bool):
        self.next, self.window, self.n_open, self.keep_ids = first_sequence, window, n_open, keep_ids
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def add(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        """Place one piece of at most a window."""
        best = None
        for w in self.open:
            if w[0] + len(ids) <= self.window and (best is None or w[0] > best[0]):
                best = w
        if best is None:
            if len(self.open) == self.n_open:
                self._emit(max(self.open, key=lambda w: w[0]))
            best = [0, []]
            self.open.append(best)
        best[1].append((doc, start, ids, doc_tokens, best[0]))
        best[0] += len(ids)
        if best[0] == self.window:
            self._emit(best)

    def full(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        self._write([(doc, start, ids, doc_tokens, 0)], False)

    def _emit(self, window: list) -> None:
        self.open = [w for w in self.open if w is not window]
        self._write(window[1], False)

    def _write(self, pieces: list, stays: bool) -> None:
        for doc, start, ids, doc_tokens, offset in pieces:
            raw = ids.astype("<u4", copy=False).tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), doc_tokens, self.next, offset,
                              raw if stays or self.keep_ids else None, stays))
        self.next += 1

    def close(self, stays: bool) -> None:
        for window in self.open:
            self._write(window[1], stays)
        self.open = []

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, *[pa.int64()] * 6, pa.binary(), pa.bool_()]
        names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "open"]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID, n_open: int = N_OPEN, keep_ids: bool = True) -> DataFrame:
    """Pieces (doc, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): where each part of a document lies.

    `ids` holds the piece's ids as little-endian unsigned 32-bit numbers, null without `keep_ids`.
    """
    id_type = docs.schema[id_col].dataType
    schema = f"doc {id_type.simpleString()}, {PIECE_COLUMNS}, ids binary, open boolean"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 32, window, n_open, keep_ids)
        doc_type = None
        for batch in batches:
            names = W.arrow_column(batch, id_col)
            doc_type = names.type
            for lo, hi, data, offsets in W.text_chunks(W.arrow_column(batch, text_col)):
                for doc, ids in zip(names[lo:hi].to_pylist(), own.encode_chunk(data, offsets), strict=True):
                    tokens = np.append(ids, np.uint32(end_id))
                    n = len(tokens)
                    whole = n - n % window
                    for start in range(0, whole, window):
                        packer.full(doc, start, tokens[start:start + window], n)
                    if n > whole:
                        packer.add(doc, whole, tokens[whole:], n)
                if len(packer.rows) >= 2000:
                    yield packer.batch(doc_type)
        packer.close(True)
        if doc_type is not None:
            yield packer.batch(doc_type)

    placed = materialize(W.map_arrow(docs.select(id_col, text_col), place, schema), "packed")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer((1 << 60) + (TaskContext.get().partitionId() << 32), window, 1, keep_ids)
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc").type
            for row in batch.to_pylist():
                ids, at = np.frombuffer(row["ids"], "<u4"), 0
                while at < len(ids):
                    room = window - (packer.open[0][0] if packer.open else 0)
                    part = ids[at:at + room]
                    packer.add(row["doc"], row["start"] + at, part, row["doc_tokens"])
                    at += len(part)
                if len(packer.rows) >= 2000:
                    yield packer.batch(doc_type)
        packer.close(False)
        if doc_type is not None:
            yield packer.batch(doc_type)

    part = F.shiftright("sequence_id", 32)
    left = placed.where("open").withColumn("part", part)
    # leftovers are bounded per task of the first pass, so the number of merging tasks follows from the number of tasks
    n_merges = 1 + (placed.where("open").select(part.alias("p")).agg(F.max("p")).first()[0] or 0) // PARTS_PER_MERGE
    merged = (left.repartition(n_merges, F.expr(f"part div {PARTS_PER_MERGE}"))
              .sortWithinPartitions("part", "sequence_id", "offset").drop("part").mapInArrow(merge, schema))
    return placed.where("NOT open").unionByName(merged).drop("open")


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per sequence: its ids in order, their number, and the length it is padded to (a power of two stays)."""
    rows = (pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "length"))).alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"),
                    F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p["length"]).alias("n_ids")))
    return rows.withColumn("padded", F.when(F.bit_count("n_ids") == 1, F.col("n_ids")).otherwise(F.lit(window).cast("bigint")))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_pack(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs, default_tokenizer(), keep_ids=False)
    return pieces.select(F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_pack": op5_pack}
ORACLES: dict[str, str] = {}
