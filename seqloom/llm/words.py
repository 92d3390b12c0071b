"""Words, lines and hashes of Arrow text columns in numpy, a bounded number of bytes at a time.

A word is a maximal run of bytes outside `\\x20\\x09-\\x0D`. All of these are ASCII, so working on UTF-8 bytes
gives the same words as working on characters. Hashes have 64 bits and are a function of the content alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES, STRETCH_BYTES, BATCH_BYTES = 1 << 20, 1 << 18, 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, one for every byte of a stretch and one more; kept between calls."""
    if not _POWERS:
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(STRETCH_BYTES + 1, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document offsets of the runs where `inside` holds; runs stop at document ends."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, from running sums over stretches of the chunk; the spans come in order and do not overlap."""
    up, down = _powers()
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + STRETCH_BYTES, "right")))
        if ends[lo] - base > STRETCH_BYTES:  # one span alone, stretch by stretch
            total, shift = 0, 1
            for at in range(base, int(ends[lo]), STRETCH_BYTES):
                part = data[at:min(at + STRETCH_BYTES, int(ends[lo]))].astype(np.uint64)
                total += int(((part + np.uint64(1)) * up[:len(part)]).sum()) * shift
                shift = shift * pow(_BASE, STRETCH_BYTES, 1 << 64) & _MASK
            out[lo] = total & _MASK
        else:
            part = data[base:int(ends[hi - 1])]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part.astype(np.uint64) * up[:len(part)] + up[:len(part)], out=total[1:])
            out[lo:hi] = (total[ends[lo:hi] - base] - total[starts[lo:hi] - base]) * down[starts[lo:hi] - base]
        lo = hi
    return mix(out)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` neighbouring word hashes, by position of the first."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k:k + n]
    return mix(out)


def owners(per_doc: np.ndarray) -> np.ndarray:
    """Document number of each item, from per-document offsets."""
    return np.repeat(np.arange(len(per_doc) - 1), np.diff(per_doc))


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags between neighbouring offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def keep_by_doc(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """One key per (document, hash), for sorting a whole chunk at once."""
    return mix(hashes ^ mix(docs.astype(np.uint64) + np.uint64(1)))


def map_arrow(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """`rows.mapInArrow(run, schema)` for wide rows: batches of `BATCH_BYTES` at most, and a worker that returns what it has freed.

    The setting is the session's and is only ever lowered.
    """
    conf = rows.sparkSession.conf
    if int(conf.get(BATCH_SETTING, str(1 << 30))) > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return rows.mapInArrow(lean, schema)


def shielded(docs: DataFrame, run: Callable[[DataFrame], DataFrame], *used: str) -> DataFrame:
    """`run(docs)`, a table with the columns of `docs`, where further columns may have names an operator uses inside.

    Columns that start with an underscore, but for those in `used`, go by other names while `run` works.
    """
    own = {c: f"other {i}" for i, c in enumerate(docs.columns) if c.startswith("_") and c not in used}
    if not own:
        return run(docs)
    return run(docs.withColumnsRenamed(own)).withColumnsRenamed({v: k for k, v in own.items()})


def trim() -> None:
    """Give freed memory back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def arrow_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
