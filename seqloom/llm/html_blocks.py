"""Main text of web pages by a recurrent labeller of text blocks.

A page becomes its sequence of text blocks, each with the path of open elements. A bidirectional LSTM in numpy reads for every
block a hashed vector of its path, a hashed vector of its words and a few lengths, and so labels each block knowing the whole
page before and after it. The labelled blocks, in page order, are the main text. The model is trained on the driver from
seeded page layouts (`html_training`), a fixed small number, and its weights (some hundred kilobytes) go to the tasks.

Defined results. Null or empty page, or one without text: empty text, length 0. Broken markup never fails: unclosed elements
end with their parents, stray end tags are ignored, an unclosed comment, script or other raw text runs to the end. Drawings and
formulas end with their parents or at the next element that only HTML has; their text, and that of objects and templates, is read
like any other, with the element on the path. Repeated rows are handled alike. Empty table: empty result. Other columns pass
through; internal columns start with `_h_`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seqloom.llm import words as W

PATH_DIM, LEAF_DIM, WORD_DIM, PLAIN_DIM = 256, 24, 32, 6
INPUT_DIM = PATH_DIM + LEAF_DIM + WORD_DIM + PLAIN_DIM
# element classes of the HTML standard
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style title iframe".split())  # text up to the end tag, not shown
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark math mi mn mo ms mtext object q "
             "s samp small span strike strong sub sup svg time tt u var wbr br".split())
SCOPES = set("html body article section main aside nav header footer div table ul ol dl form blockquote figure td th object template "
             "foreignobject".split())
FOREIGN = {"svg", "math"}
EMBEDDED = FOREIGN | {"object"}
HOLDS_HTML = set("foreignobject desc annotation-xml mi mn mo ms mtext".split())  # inside drawings and formulas
FOREIGN_BLOCKS = {"text", "desc", "foreignobject"}  # all other elements of drawings and formulas stand in the line
ENDS_FOREIGN = SCOPES - {"object", "template", "foreignobject"} | set(
    "address b big br button caption center code dd details dt em embed fieldset figcaption h1 h2 h3 h4 h5 h6 head hr i img legend li "
    "meta option p pre s select small span strong strike sub summary sup tbody tfoot thead tr tt u var".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}

_TAG = re.compile(r"<(?:!--|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*)>?))", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")


class Block:
    __slots__ = ("text", "path", "leaf", "linked")

    def __init__(self, text: str, path: tuple, leaf: str, linked: int):
        self.text, self.path, self.leaf, self.linked = text, path, leaf, linked


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to the path: its tag and the name parts of its class, id and role."""
    out = ["t:" + tag]
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "style":
                out += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
            elif name in ("hidden", "aria-hidden"):
                out += ["hidden"] if value not in ("false",) else []
            else:
                out += ["c:" + part for part in _NAME.findall(value)]
    return tuple(out)


def page_blocks(html: str) -> list[Block]:
    """Text blocks of a page in order; block elements divide, inline elements and line breaks do not."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    place: tuple | None = None
    aside = False  # the place is that of an embedded element, until text outside of it comes
    linked, anchors, embedded, pos, end = 0, 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal place, aside, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, place[0], place[1], linked))
            parts.clear()
        place, aside, linked = None, False, 0

    def say(raw: str) -> None:
        nonlocal place, aside, linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if (place is None or aside and not embedded) and not text.isspace():
            aside = embedded > 0
            leaf = next((tag for tag, _ in reversed(stack) if tag not in INLINE), "")
            place = (tuple(marks for _, marks in stack), leaf)
        if anchors:
            linked += len(text)

    def close(i: int) -> None:
        nonlocal anchors, embedded
        anchors -= sum(t == "a" for t, _ in stack[i:])
        embedded -= sum(t in EMBEDDED for t, _ in stack[i:])
        del stack[i:]

    def foreign() -> int:
        """Where in the stack the drawing or formula begins whose elements are read now, or -1."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in FOREIGN:
                return i
            if stack[i][0] in HOLDS_HTML:
                break
        return -1

    while pos < end:
        m = _TAG.search(html, pos)
        if m is None:
            say(html[pos:])
            break
        if m.start() > pos:
            say(html[pos:m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            if html.startswith("<!--", m.start()):
                after = html.find("-->", m.start() + 4)
                pos = end if after < 0 else after + 3
            continue
        tag, attributes = tag.lower(), m[3] or m[4] or ""  # the second form has an unclosed quote
        root = foreign() if embedded else -1
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1) if m[1] else -1
        if tag in ENDS_FOREIGN and not m[1]:
            while root >= 0:
                close(root)
                root = foreign()
        # an end tag from outside the drawing or formula is one of HTML
        inline = tag in INLINE or root >= 0 and tag not in FOREIGN_BLOCKS and tag not in ENDS_FOREIGN and (at < 0 or at >= root)
        if not inline:
            flush()
        if tag == "br":
            parts.append(" ")
        elif m[1]:
            if at >= 0:
                close(at)
        elif tag in RAW and (root < 0 or not attributes.endswith("/")):
            # inside a drawing or formula it ends there at the latest
            until = f"{tag}|{stack[root][0]}" if root >= 0 else re.escape(tag)
            after = re.compile(rf"</({until})(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            if after is not None:
                pos = after.end() if after[1].lower() == tag else after.start()
            elif root < 0:
                pos = end
        elif tag in VOID or tag == "head":
            pass
        else:
            ended = ENDED_BY.get(tag) or (() if inline else {"p"})
            for i in range(len(stack) - 1, -1, -1) if root < 0 else ():
                if stack[i][0] in ended:
                    close(i)
                    break
                if stack[i][0] in SCOPES:
                    break
            if not attributes.endswith("/"):
                stack.append((tag, _marks(tag, attributes)))
                anchors += tag == "a"
                embedded += tag in EMBEDDED
    flush()
    return blocks


def _cell(name: str, dim: int) -> int:
    return zlib.crc32(name.encode()) % dim


class Features:
    """Input vectors of blocks; path vectors repeat a lot and are kept, up to a bound."""

    def __init__(self):
        self.paths: dict[tuple, np.ndarray] = {}

    def _path(self, path: tuple, leaf: str) -> np.ndarray:
        key = (path, leaf)
        out = self.paths.get(key)
        if out is None:
            out = np.zeros(PATH_DIM + LEAF_DIM, np.float32)
            for marks in path:
                for mark in marks:  # two cells each, so that few marks look alike
                    out[[_cell(mark, PATH_DIM), _cell(mark + "'", PATH_DIM)]] = 1
            out[PATH_DIM + _cell(leaf, LEAF_DIM)] = 1
            if len(self.paths) >= 20_000:
                self.paths.clear()
            self.paths[key] = out
        return out

    def pages(self, pages: list[list[Block]]) -> np.ndarray:
        """One row per block of all pages."""
        blocks = [b for page in pages for b in page]
        out = np.zeros((len(blocks), INPUT_DIM), np.float32)
        if not blocks:
            return out
        out[:, :PATH_DIM + LEAF_DIM] = [self._path(b.path, b.leaf) for b in blocks]
        at, words = 0, out[:, PATH_DIM + LEAF_DIM:PATH_DIM + LEAF_DIM + WORD_DIM]
        for lo, hi, data, offsets in W.text_chunks(pa.array([b.text for b in blocks])):
            data = W.LOWER[data]
            starts, ends, per = W.spans(~W.SPACE[data], offsets)
            cell = (W.span_hashes(data, starts, ends) % np.uint64(WORD_DIM)).astype(np.int64)
            count = np.bincount(W.owners(per) * WORD_DIM + cell, minlength=(hi - lo) * WORD_DIM).reshape(hi - lo, WORD_DIM)
            words[lo:hi] = count / np.maximum(1, np.sqrt((count**2).sum(axis=1, keepdims=True)))
            plain = out[lo:hi, -PLAIN_DIM:]
            size = np.array([len(b.text) for b in blocks[lo:hi]])
            plain[:, 0] = np.log1p(size) / 8
            plain[:, 1] = np.array([b.linked for b in blocks[lo:hi]]) / size
            plain[:, 2] = np.log1p(np.diff(per)) / 6
        at = 0
        for page in pages:
            n = len(page)
            if n:
                place = (np.arange(n) + 0.5) / n
                out[at:at + n, -3], out[at:at + n, -2] = place, 1 - place
                out[at:at + n, -1] = np.log1p(n) / 6
            at += n
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """States of one direction for (time, page, input); outside `mask` the state stays as it is. Also what training needs."""
    steps, pages, _ = x.shape
    size = u.shape[0]
    pre = x @ w + b
    h, c = np.zeros((pages, size), np.float32), np.zeros((pages, size), np.float32)
    out, kept = np.zeros((steps, pages, size), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ u
        gates = sigmoid(z[:, :3 * size])
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        g = np.tanh(z[:, 3 * size:])
        new_c = f * c + i * g
        th = np.tanh(new_c)
        m = mask[t][:, None]
        kept.append((h, c, i, f, o, g, th))
        h, c = np.where(m, o * th, h), np.where(m, new_c, c)
        out[t] = h
    return out, kept


class Labeller:
    """Scores of blocks from both reading directions."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def scores(self, rows: np.ndarray, lengths: list[int]) -> np.ndarray:
        """Score of every block; pages of like length run together, a bounded number of cells at a time."""
        out = np.zeros(len(rows), np.float32)
        starts = np.append(0, np.cumsum(lengths))
        order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: lengths[i])
        while order:
            longest = lengths[order[-1]]
            group = order[-max(1, 20_000 // longest):]
            del order[-len(group):]
            x, mask = pad([rows[starts[i]:starts[i + 1]] for i in group])
            s = self.forward(x, mask)[0]
            for k, i in enumerate(group):
                out[starts[i]:starts[i + 1]] = s[:lengths[i], k]
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray):
        p = self.weights
        left, kept_left = lstm(x, p["wf"], p["uf"], p["bf"], mask)
        right, kept_right = lstm(x[::-1], p["wb"], p["ub"], p["bb"], mask[::-1])
        h = np.concatenate([left, right[::-1], x], axis=2)
        return sigmoid(h @ p["v"] + p["c"])[:, :, 0], h, kept_left, kept_right


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, page, input) with zeros after the end of each page, and where pages have blocks."""
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), INPUT_DIM), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k], mask[:len(p), k] = p, True
    return x, mask


def main_texts(pages: list[str], labeller: Labeller, features: Features) -> list[str]:
    parsed = [page_blocks(p) for p in pages]
    scores = labeller.scores(features.pages(parsed), [len(p) for p in parsed])
    out, at = [], 0
    for blocks in parsed:
        out.append("\n".join(b.text for b, s in zip(blocks, scores[at:at + len(blocks)], strict=True) if s >= 0.5))
        at += len(blocks)
    return out


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`pages` (or only its columns `keep`) with `_h_text`, the main text, and `_h_n_chars`, its code points."""
    from seqloom.llm.html_training import trained

    weights = pages.sparkSession.sparkContext.broadcast(trained())
    fields = [f for f in pages.schema if keep is None or f.name in keep]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("_h_text", T.StringType()), T.StructField("_h_n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, features = Labeller(weights.value), Features()
        for batch in batches:
            lo = 0
            sizes = W.arrow_column(batch, html_col).cast(pa.large_string()).fill_null("")
            ends = np.cumsum([len(s) for s in sizes.to_pylist()]) if len(sizes) else np.zeros(0, int)
            while lo < batch.num_rows:
                # about four million characters of pages at a time
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (4 << 20), "right")))
                texts = main_texts(sizes.slice(lo, hi - lo).to_pylist(), labeller, features)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([W.arrow_column(part, c) for c in names] + [pa.array(texts, pa.string()),
                                                 pa.array([len(t) for t in texts], pa.int64())], names=[*names, "_h_text", "_h_n_chars"])
                lo = hi

    return W.map_arrow(pages.select(*dict.fromkeys([*names, html_col])), run, schema)


def op4_html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, keep=["page_id", "url"]).withColumnsRenamed({"_h_text": "text", "_h_n_chars": "n_chars"})


QUERIES = {"op4_html_main_text": op4_html_main_text}
ORACLES: dict[str, str] = {}
