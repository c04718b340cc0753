"""Turns inside one transcript: splitting, numbering, parsing and normalising.

A transcript is one row, so all of this is a narrow projection over that row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import let, non_blank_lines, strip, tidy_lines


def user_or_system(speaker: Column) -> Column:
    """Customer-like names become ``user``; everything else, also a missing name, ``system``."""
    return F.when(F.lower(speaker).isin(fixed.USER_ALIASES), "user").otherwise("system")


def speaker_has(speaker: Column, part: str) -> Column:
    return F.contains(F.lower(speaker), F.lit(part.lower()))


def split_plain_text(text: Column) -> Column:
    """Turns of a plain transcript: a line that begins with a known speaker label opens one."""
    labels = "|".join(fixed.SPEAKER_LABELS)
    one_line_each = F.regexp_replace(tidy_lines(text), rf"\n(?!(?:{labels}):)", " ")
    return F.filter(F.split(one_line_each, "\n"), lambda turn: turn != "")


def number_turns(lines: Column) -> Column:
    """``Turn i: <line>`` for every line, joined by newlines."""
    numbered = F.transform(
        lines, lambda line, i: F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(": "), line)
    )
    return F.array_join(numbered, "\n")


def label_turn(speaker: Column, text: Column) -> Column:
    return F.concat(speaker, F.lit(": "), text)


def _labelled_turns(lines: Column) -> Column:
    pattern = "^(" + "|".join(fixed.SPEAKER_LABELS) + "):"
    return F.transform(
        lines,
        lambda line, i: F.struct(
            (i + 1).alias("number"),
            F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).alias("speaker"),
            strip(F.regexp_replace(line, pattern, "")).alias("text"),
        ),
    )


def plain_text_episode(text: Column) -> Column:
    """Struct of ``turns, text, text_with_turns, turn_count`` of a plain transcript.

    Text without any line is one turn of an unknown speaker.
    """
    single = F.array(F.struct(
        F.lit(1).alias("number"), F.lit("Unknown").alias("speaker"), text.alias("text")
    ))

    def episode(lines: Column) -> Column:
        found = F.size(lines) > 0
        return F.struct(
            F.when(found, _labelled_turns(lines)).otherwise(single).alias("turns"),
            F.when(found, F.array_join(lines, "\n")).otherwise(text).alias("text"),
            F.when(found, number_turns(lines))
            .otherwise(F.concat(F.lit("Turn 1: Unknown: "), text)).alias("text_with_turns"),
            F.when(found, F.size(lines)).otherwise(1).alias("turn_count"),
        )

    return let(split_plain_text(text), episode)


def parse_turns(transcript: Column) -> Column:
    """All ``Turn N: Speaker: Text`` lines of a transcript, in order; other lines are left out.

    Everything after the second colon is text, colons included.
    """
    lines = F.filter(non_blank_lines(transcript), lambda line: line.startswith("Turn "))
    parts = F.filter(F.transform(lines, lambda line: F.split(line, ":", 3)), lambda p: F.size(p) == 3)

    def turn(p: Column) -> Column:
        number = strip(F.replace(p[0], F.lit("Turn "), F.lit("")))
        return F.struct(
            F.when(number.rlike(r"^[+-]?\d+\z"), number.try_cast("bigint")).alias("number"),
            strip(p[1]).alias("speaker"),
            strip(p[2]).alias("text"),
        )

    return F.filter(F.transform(parts, turn), lambda t: t["number"].isNotNull())
