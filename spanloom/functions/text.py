"""Text expressions with the sizes and whitespace rules the tables record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 units; equals ``length`` except for astral characters."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / F.lit(2)).cast("bigint")


def collapse(c: Column) -> Column:
    """Runs of whitespace become one space, ends trimmed."""
    return F.regexp_replace(
        F.regexp_replace(c, r"(?U)[\s\x{FEFF}]+", " "), "^ | $", ""
    )


def blank(c: Column) -> Column:
    return c.isNull() | (collapse(c) == "")


def half_up(c: Column) -> Column:
    """Round half towards +infinity, as a whole number."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def preview(c: Column, n: int = 100) -> Column:
    flat = collapse(c)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, n), F.lit("…")))


def clip(c: Column, n: int) -> Column:
    """Collapse and clip to n characters, on a word boundary past 60 % of n."""
    flat = collapse(c)
    cut = F.substring(flat, 1, n)
    at = F.length(cut) - F.locate(" ", F.reverse(cut))
    on_word = F.when((F.locate(" ", cut) > 0) & (at > n * 0.6), F.left(cut, at.cast("int"))).otherwise(cut)
    return F.when(F.length(flat) <= n, flat).otherwise(
        F.concat(on_word, F.lit("…"))
    )


def sha(c: Column, chars: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, chars)


def like_any(c: Column, text: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the text stay wildcards, a backslash is itself."""
    said = text.lower().replace("\\", "\\\\")
    return F.lower(c).like(f"%{said}%")
