"""Text cleaning, title rules and answer comparison as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.hashing import portable_hash

# Patterns and names that decide what text comes out. Blanks are what Python calls
# whitespace; word characters are letters, numbers and the underscore of any script.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
ANY_TAG = r"<[^>]+>"
NAMED_TAG = r"</?[\p{L}\p{N}_]+[^>]*>"
QUOTES_AND_NEWLINES = r'["\n\r]'
TITLE_WORD_LIMIT = 20
NO_TEXT = "unknown item"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"  # what html.unescape looks at
END_MARKERS = r"<\|im_end\|>|<\|endoftext\|>"
REVIEW_CATEGORY_NAMES = {
    "Arts": "Arts_Crafts_and_Sewing",
    "Games": "Video_Games",
    "Sports": "Sports_and_Outdoors",
    "Instruments": "Musical_Instruments",
    "Scientific": "Scientific",
}
CATEGORY_PHRASES = {
    "Industrial_and_Scientific": "industrial and scientific items",
    "Office_Products": "office products",
    "Toys_and_Games": "toys and games",
    "Sports": "sports and outdoors",
    "Books": "books",
}


@F.pandas_udf(T.StringType())
def _decoded(references: pd.Series) -> pd.Series:
    """Decoded references of every row, parted by U+001F; they come parted by newlines, which none of them contains."""

    def decode(row: str) -> str:
        return "\u001f".join(html.unescape(r).replace("\u001e", "\u001e0").replace("\u001f", "\u001e1") for r in row.split("\n"))

    return references.map(decode, na_action="ignore")


def _swapped(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column | str) -> Column:
    """HTML entities to characters: Spark has no built-in, so the references, and nothing else of a text, go through the standard library."""
    col = F.col(text) if isinstance(text, str) else text
    packed = _decoded(F.nullif(F.array_join(F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0)), "\n"), F.lit("")))
    decoded = F.transform(F.split(packed, "\u001f"), lambda t: _swapped(t, ("\u001e1", "\u001f"), ("\u001e0", "\u001e")))
    between = F.zip_with(F.split(col, REFERENCE), F.concat(decoded, F.array(F.lit(""))), lambda t, r: F.concat(t, r))
    return F.when(packed.isNull(), col).otherwise(F.array_join(between, ""))


def _blanks_as_spaces(text: Column) -> Column:
    return F.translate(text, BLANKS, " " * len(BLANKS))


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(text, F.lit(BLANKS))


def clean_review(text: Column | str) -> Column:
    """Null-safe review text: tags out, entities decoded (twice for quotes and ampersands), blanks collapsed."""
    col = F.col(text) if isinstance(text, str) else text
    bare = unescape(F.regexp_replace(F.coalesce(col, F.lit("")), ANY_TAG, ""))
    bare = F.replace(F.replace(bare, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.btrim(F.regexp_replace(_blanks_as_spaces(bare), " {2,}", " "))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(text), NAMED_TAG, ""), QUOTES_AND_NEWLINES, "")


def _one_final_dot(text: Column, limit: int | None) -> Column:
    """End with a single dot; the first character is never taken for a trailing dot."""
    ended = F.concat(F.regexp_replace(text, r"(?s)(?<=.)\.+\z", ""), F.lit("."))
    return ended if limit is None else F.when(F.length(ended) >= limit, F.lit("")).otherwise(ended)


def clean_for_encoder(text: Column | str, limit: int | None = None) -> Column:
    """Encoder text of a string column; with a limit, texts of that many characters or more become empty."""
    return _one_final_dot(_plain(strip(F.col(text) if isinstance(text, str) else text)), limit)


def clean_map_for_encoder(texts: Column | str, limit: int | None = None) -> Column:
    """Encoder text of a map column: keys and values in order, cleaned as a list."""
    col = F.col(texts) if isinstance(texts, str) else texts
    return clean_list_for_encoder(F.flatten(F.transform(F.map_entries(col), lambda e: F.array(e["key"], e["value"]))), limit)


def clean_list_for_encoder(texts: Column | str, limit: int | None = None) -> Column:
    """Encoder text of an array column: elements cleaned, trimmed and joined by a blank.

    The elements travel as one delimited string, so the Arrow step sees one value per row; a delimiter inside an element is
    written as two other characters meanwhile.
    """
    col = F.col(texts) if isinstance(texts, str) else texts
    packed = unescape(F.array_join(F.transform(col, lambda t: _swapped(t, ("\u001e", "\u001e0"), ("\u001f", "\u001e1"))), "\u001f"))
    parts = F.transform(
        F.transform(F.split(packed, "\u001f"), lambda t: _swapped(t, ("\u001e1", "\u001f"), ("\u001e0", "\u001e"))),
        lambda t: strip(F.regexp_replace(F.regexp_replace(t, NAMED_TAG, ""), QUOTES_AND_NEWLINES, "")),
    )
    return _one_final_dot(F.when(F.size(col) > 0, F.array_join(parts, " ")).otherwise(F.lit("")), limit)


def title_present(title: Column | str) -> Column:
    """Lenient rule: a title that is more than whitespace."""
    col = F.col(title) if isinstance(title, str) else title
    return F.coalesce(F.length(strip(col)) > 0, F.lit(False))


def clean_title(title: Column | str) -> Column:
    """Strict title clean: two entities decoded, then outer blanks and outer quotes removed."""
    col = F.col(title) if isinstance(title, str) else title
    decoded = F.replace(F.replace(col, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.btrim(F.btrim(decoded), F.lit('"'))


def title_strict(title: Column | str) -> Column:
    """Strict rule: no markup span, more than one character, at most 20 blank-separated words."""
    col = F.col(title) if isinstance(title, str) else title
    cleaned = clean_title(col)
    ok = (
        ~F.contains(col, F.lit("<span id"))
        & (F.length(cleaned) > 1)
        & (F.size(F.split(cleaned, " ")) <= TITLE_WORD_LIMIT)
    )
    return F.coalesce(ok, F.lit(False))


def clean_brand(brand: Column | str) -> Column:
    col = F.col(brand) if isinstance(brand, str) else brand
    return strip(F.replace(col, F.lit("by\n"), F.lit("")))


def parse_categories(raw: Column | str) -> Column:
    """Raw JSON text of a flat or nested list to one flat array."""
    col = F.col(raw) if isinstance(raw, str) else raw
    nested = F.flatten(F.from_json(col, "array<array<string>>"))
    return F.coalesce(nested, F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def description_text(description: Column | str) -> Column:
    """Raw description of a metadata file: a JSON list becomes its first element, the empty list empty text."""
    col = F.col(description) if isinstance(description, str) else description
    listed = F.from_json(col, "array<string>", {"allowSingleQuotes": "true"})
    return F.when(col.startswith("[") & col.endswith("]") & listed.isNotNull(), F.coalesce(F.get(listed, F.lit(0)), F.lit(""))).otherwise(col)


def join_categories(categories: Column | str) -> Column:
    """Comma-joined categories without leftover markup."""
    col = F.col(categories) if isinstance(categories, str) else categories
    kept = F.filter(col, lambda c: ~F.contains(c, F.lit("</span>")))
    return strip(F.array_join(F.transform(kept, strip), ","))


def item_text(title: Column | str, description: Column | str, limit: int | None = None) -> Column:
    """Cleaned title and description joined by a blank, or a stand-in when both are empty."""
    parts = [strip(clean_for_encoder(c, limit)) for c in (title, description)]
    filled = F.concat_ws(" ", *[F.when(p != "", p) for p in parts])
    return F.when(filled == "", F.lit(NO_TEXT)).otherwise(filled)


def track_title(item: Column, seconds: Column) -> Column:
    """`Track <id> - m min s sec`, or `Track <id>` when the length is unknown."""
    timed = F.concat(
        F.lit("Track "), item.cast("string"), F.lit(" - "), F.floor(seconds / 60).cast("string"),
        F.lit(" min "), F.pmod(seconds, F.lit(60)).cast("string"), F.lit(" sec"),
    )
    return F.when(seconds.isNotNull(), timed).otherwise(F.concat(F.lit("Track "), item.cast("string")))


def lookup_name(code: Column, names: dict[str, str]) -> Column:
    """Code to display name through a literal map; unknown codes stay as they are."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[code], code)


def answer_core(text: Column | str, blanks: bool = True) -> Column:
    """Strip outer newlines and quotes (and blanks) before answers are compared."""
    col = F.col(text) if isinstance(text, str) else text
    return F.btrim(col, F.lit('\n" ' if blanks else '\n"'))


def same_answer(a: Column | str, b: Column | str, blanks: bool = True) -> Column:
    return answer_core(a, blanks) == answer_core(b, blanks)


def after_response(text: Column | str, marker: str = "Response:\n") -> Column:
    """Text after the last marker, trimmed; the whole text when there is none."""
    return strip(F.substring_index(F.col(text) if isinstance(text, str) else text, marker, -1))


def drop_end_markers(text: Column | str) -> Column:
    return F.regexp_replace(text, END_MARKERS, "")


def word_count(text: Column | str) -> Column:
    """Whitespace-separated words; 0 for blank text."""
    spaced = _blanks_as_spaces(F.col(text) if isinstance(text, str) else text)
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("bigint")


def drop_words(text: Column | str, key: Column | str, ratio: float, seed: int = 42) -> Column:
    """Drop each blank-separated word with probability `ratio`; the draw depends on (key, position, seed) only."""
    col = F.col(text) if isinstance(text, str) else text
    row = (F.col(key) if isinstance(key, str) else key).cast("string")
    scale = float(2**60)
    kept = F.filter(
        F.split(col, " "),
        lambda w, i: portable_hash(row, i, seed=seed).cast("double") / scale > ratio,
    )
    return F.array_join(kept, " ")


def month_start(year: Column, month: Column) -> Column:
    """Epoch seconds of the first instant of a month, UTC, whatever the session zone."""
    return (F.datediff(F.make_date(year, month, F.lit(1)), F.lit("1970-01-01").cast("date")) * F.lit(86400)).cast("bigint")
