"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docloom.sources.dimensions import HEADER_MARKERS

NUMERIC_TAIL = r"(?:^| )[\d.,]+ [\d.,]+(?: \S*[^\d.,\s]\S*)*$"
NULL_WORDS = ("null", "none", "unknown", "неизвестно", "n/a", "-")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def split_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def clean_invoice_text(c: Column) -> Column:
    """No CR, blanks and tabs folded in each line, no empty line."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "\r", "")
    lines = F.transform(split_lines(text), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def scan_lines(c: Column) -> Column:
    """The folded non-empty lines of a scan; CR ends a line, NBSP is a blank."""
    text = F.translate(F.coalesce(c, F.lit("")), "\r\u00a0", "\n ")
    return F.filter(F.transform(split_lines(text), fold), lambda x: x != "")


def normalize_ocr_text(c: Column) -> Column:
    """Line ends unified, blanks folded, at most one empty line in a row, stripped; empty lines stay."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t\f\x0B]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def item_zone(c: Column) -> Column:
    """T4: from the first line with three pipes on; the whole text if there is none."""
    lines = split_lines(F.coalesce(c, F.lit("")))
    flags = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 3)
    at = F.array_position(flags, True)
    return F.when(at > 0, F.array_join(F.slice(lines, at.cast("int"), F.size(lines)), "\n")).otherwise(F.coalesce(c, F.lit("")))


def effectively_empty(c: Column) -> Column:
    """T5: fewer than 8 letters and digits once Markdown images and heading marks are gone."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " "), r"(?m)^\s*#+\s*", "")
    return F.length(F.regexp_replace(text, "[^A-Za-zА-Яа-яЁё0-9]", "")) < 8


def nullish(c: Column) -> Column:
    """Folded text, null if it says nothing."""
    text = fold(c)
    return F.when(~F.lower(text).isin("", *NULL_WORDS), text)


def content_lines(c: Column) -> Column:
    """Lines without Markdown images, those that say nothing dropped."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " ")
    return F.filter(F.transform(split_lines(text), nullish), lambda x: x.isNotNull())


ANCHORS = (r"(?iu)\bпротокол\s+испытан", r"(?i)\btest\s+report\b", r"(?i)\breport\b")


def header_block(c: Column, reach: int = 1800) -> Column:
    """Text before the earliest report heading, else its first ``reach`` characters, cleaned."""
    text = F.coalesce(c, F.lit(""))
    before = lambda a: F.when(text.rlike(a), F.length(F.element_at(F.split(text, a, 2), 1)))
    at = F.coalesce(F.least(*[before(a) for a in ANCHORS]), F.lit(reach))
    head = F.regexp_replace(F.substring(text, F.lit(1), at), r"!\[[^\]]*\]\([^)]+\)", " ")
    return normalize_ocr_text(F.regexp_replace(head, r"(?m)^#+\s*", ""))


def clean_description(c: Column) -> Column:
    """Tags to blanks, folded, without blanks, dots and commas at the ends."""
    return F.regexp_replace(fold(F.regexp_replace(c, "<[^>]+>", " ")), r"^[ .,]+|[ .,]+$", "")


def numeric_tail(line: Column) -> Column:
    return line.rlike(NUMERIC_TAIL)


def has_any(low: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return out


def header_only(line: Column) -> Column:
    """P5: has a header marker and no numeric tail."""
    low = F.lower(line)
    return has_any(low, HEADER_MARKERS) & ~numeric_tail(low)
