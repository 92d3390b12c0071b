"""Semantic-ID tokens: building, joining, parsing and unpacking codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token formats; the letter names the level, a = first.
TOKEN = ("<", "_", ">")
PIPE_TOKEN = ("<|", "_", "|>")


def tokens(codes: Column | str, offset: int = 1, style: tuple[str, str, str] = TOKEN) -> Column:
    """One token per level, such as <a_12>; `offset` is 1 for 1-based and 0 for 0-based numbering."""
    head, middle, tail = style
    return F.transform(
        codes,
        lambda c, level: F.concat(
            F.lit(head), F.char(level + 97), F.lit(middle), (c + offset).cast("string"), F.lit(tail)),
    )


def sid(token_array: Column | str) -> Column:
    return F.array_join(token_array, "")


def sid_prefix(token_array: Column | str, levels: int = 3) -> Column:
    """The first `levels` tokens joined, null when there are fewer."""
    col = F.col(token_array) if isinstance(token_array, str) else token_array
    return F.when(F.size(col) >= levels, F.array_join(F.slice(col, 1, levels), ""))


def parse_sid(text: Column | str) -> Column:
    """Tokens of a joined SID in either bracket style."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(col, F.lit(r"<\|?[a-z]_\d+\|?>"), F.lit(0))


def parse_codes(text: Column | str, offset: int = 1) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    digits = F.regexp_extract_all(col, F.lit(r"_(\d+)"), F.lit(1))
    return F.transform(digits, lambda d: d.cast("int") - offset)


def pack(byte_array: Column | str) -> Column:
    """Little-endian bytes (0..255) to one integer."""
    return F.aggregate(
        F.transform(byte_array, lambda b, i: b.cast("bigint") * F.pow(F.lit(2.0), i * 8).cast("bigint")),
        F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def unpack(word: Column | str, bits: int, levels: int) -> Column:
    """Level codes stored `bits` wide in one integer, lowest level first."""
    col = F.col(word) if isinstance(word, str) else word
    mask = (1 << bits) - 1
    return F.array(*[F.shiftright(col, level * bits).bitwiseAND(F.lit(mask)).cast("int") for level in range(levels)])
