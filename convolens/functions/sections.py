"""Parsing of completion texts: concept lists, question sections and plain lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import let, non_blank_lines, strip, word_count


def header_category(line: Column) -> Column:
    """Category opened by a line, NULL when the line is no header. Bullets count as well."""
    upper = F.upper(line)
    return (
        F.when(upper.contains("ROOT_CAUSE") | upper.contains("CAUSAL"), "causal")
        .when(upper.contains("IMPACT"), "impact")
        .when(upper.contains("SCENARIO") | upper.contains("PATTERN"), "pattern")
    )


def bullet_text(line: Column) -> Column:
    """Concept of a bullet line without closing punctuation; NULL for any other line."""
    body = strip(F.substring(line, 2, 2**31 - 1))
    is_bullet = line.startswith("-") | line.startswith("•")
    return F.when(is_bullet & (F.char_length(body) > 2), F.regexp_replace(body, r"[.,;:]+\z", ""))


def concepts(response: Column) -> Column:
    """Concepts of a response as ARRAY<STRUCT<category, pos, concept>>.

    The category of a header holds for the lines up to the next header, so each header takes the
    slice of lines behind it.
    """

    def between(lines: Column) -> Column:
        marks = F.filter(
            F.transform(lines, lambda line, i: F.struct(header_category(line).alias("category"), i.alias("at"))),
            lambda mark: mark["category"].isNotNull(),
        )
        return let(marks, lambda heads: F.flatten(F.transform(heads, lambda head, k: of_header(lines, heads, head, k))))

    def of_header(lines: Column, heads: Column, head: Column, k: Column) -> Column:
        end = F.coalesce(F.get(heads, k + 1)["at"], F.size(lines))
        own = F.slice(lines, head["at"] + 2, end - head["at"] - 1)
        items = F.transform(own, lambda line, i: F.struct(
            head["category"].alias("category"),
            (head["at"] + 1 + i).alias("pos"),
            bullet_text(line).alias("concept"),
        ))
        return F.filter(items, lambda item: item["concept"].isNotNull())

    return let(non_blank_lines(response), between)


def concept_map(response: Column) -> Column:
    """MAP<category, ARRAY<concept>> with all three categories present."""

    def of(found: Column, name: str) -> Column:
        return F.transform(F.filter(found, lambda c: c["category"] == name), lambda c: c["concept"])

    return let(
        concepts(response),
        lambda found: F.create_map(
            *[part for name in fixed.CATEGORIES for part in (F.lit(name), of(found, name))]
        ),
    )


def question_sections(response: Column) -> Column:
    """Text after each ``QUESTION_n:`` mark, at most three.

    White space after a mark is skipped first, so an empty section takes in the next mark.
    """
    found = F.regexp_extract_all(
        F.coalesce(response, F.lit("")),
        F.lit(r"(?s)QUESTION_\d+:\s*(.+?)(?=QUESTION_\d+:|\z)"),
        F.lit(1),
    )
    return F.slice(found, 1, len(fixed.CATEGORIES))


def is_followup_line(line: Column) -> Column:
    return (
        (F.char_length(line) >= fixed.MIN_FOLLOWUP_CHARS)
        & F.contains(line, F.lit("?"))
        & (word_count(line) <= fixed.MAX_FOLLOWUP_WORDS)
    )


def strip_tag(line: Column) -> Column:
    """Remove one leading ``[tag]``."""
    return strip(F.regexp_replace(line, r"^\[.*?\]\s*", ""))


def first_question(section: Column) -> Column:
    """First usable line of a section, NULL when there is none."""
    return F.get(F.filter(non_blank_lines(section), is_followup_line), F.lit(0))


def followups(response: Column, limit: int = fixed.MAX_FOLLOWUPS) -> Column:
    """ARRAY<STRUCT<question, category, sequence>>; the category goes by section position."""
    names = F.array(*[F.lit(c) for c in fixed.CATEGORIES])
    items = F.transform(
        question_sections(response),
        lambda section, i: F.struct(
            strip_tag(first_question(section)).alias("question"),
            F.coalesce(F.get(names, i), F.lit(fixed.OTHER_CATEGORY)).alias("category"),
            (i + 1).alias("sequence"),
        ),
    )
    return F.slice(F.filter(items, lambda q: q["question"].isNotNull()), 1, limit)


def lines_or(response: Column, fallback: Column) -> Column:
    """Lines of a response, or the fallback alone when the response is NULL or empty."""
    given = F.coalesce(response, F.lit("")) != ""
    return F.when(given, non_blank_lines(response)).otherwise(F.array(fallback))
