"""Tokenising, trimming and n-grams as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import fixed

# Python's idea of white space: wider than Java's \s, so it is spelled out.
_SPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE_CHARS = "".join(map(chr, _SPACE_CODES))
_SPACES = "".join(rf"\x{{{code:x}}}" for code in _SPACE_CODES)
_WORD_CHAR = r"[\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces and newlines included."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(text, F.lit(rf"[^{_SPACES}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[^{_SPACES}]+"))


def ascii_words(text: Column, min_chars: int) -> Column:
    """Lower-cased runs of at least ``min_chars`` a-z letters that are whole words.

    A run next to any other letter, digit or underscore is part of a longer word and is left
    out, so accented words do not yield fragments.
    """
    pattern = rf"(?<!{_WORD_CHAR})[a-z]{{{min_chars},}}(?!{_WORD_CHAR})"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def unicode_words(text: Column, min_chars: int = 2) -> Column:
    """Lower-cased words of at least ``min_chars`` letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{_WORD_CHAR}{{{min_chars},}}"), F.lit(0))


def without(tokens: Column, stop_words: list[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(stop_words))


def ngrams(tokens: Column, n: int) -> Column:
    """Adjacent runs of ``n`` tokens joined by one space; empty when there are fewer tokens."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
    return F.coalesce(
        F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")),
        F.array().cast("array<string>"),
    )


def keywords(query: Column) -> Column:
    """Search words of a query.

    Stop words and words of up to three characters go *before* edge punctuation is trimmed, so
    ``why?`` survives as ``why``.
    """
    kept = F.filter(
        words(F.lower(query)),
        lambda w: ~w.isin(fixed.EVIDENCE_STOP_WORDS) & (F.char_length(w) > 3),
    )
    trimmed = F.transform(kept, lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+\z", ""))
    return F.filter(trimmed, lambda w: w != "")


def non_blank_lines(text: Column) -> Column:
    """Trimmed lines without the blank ones; NULL text gives no lines."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    return F.filter(lines, lambda line: line != "")


def tidy_lines(text: Column) -> Column:
    """The text with every line trimmed and blank lines removed; NULL becomes empty."""
    return F.array_join(non_blank_lines(text), "\n")


def excerpt(text: Column, n: int = fixed.EXCERPT_CHARS) -> Column:
    return F.substring(text, 1, n)


def shorten(text: Column, n: int) -> Column:
    """First ``n`` characters and an ellipsis if anything was cut."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
