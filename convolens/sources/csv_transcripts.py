"""Transcripts in CSV files: one conversation per row, under varying column names."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.literals import python_list_as_json
from ..functions.text import let, strip
from ..functions.turns import label_turn, number_turns, plain_text_episode
from .blocks import CSV, CSV_LINES, split_records

_OVERFLOW = "_overflow"


@dataclass(frozen=True)
class LoadedTranscripts:
    """``episodes`` are the usable rows, ``rejected`` the rows that could not be read."""

    episodes: DataFrame
    rejected: DataFrame

    def stats(self) -> DataFrame:
        """One row: rows loaded and rows rejected. The rejected rows themselves stay a table."""
        loaded = self.episodes.agg(F.count("*").alias("total_loaded"))
        errors = self.rejected.agg(F.count("*").alias("parse_errors"))
        return loaded.select("total_loaded", errors.scalar().alias("parse_errors"))


_CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


def pick(columns: dict[str, Column], names: list[str]) -> Column:
    """First non-null of the columns that exist, in the order of ``names``."""
    present = [columns[n].cast("string") for n in names if n in columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def pick_id(columns: dict[str, Column], row_index: Column) -> Column:
    return F.coalesce(pick(columns, fixed.ID_COLUMNS), F.format_string("T_%04d", row_index))


def pick_domain(columns: dict[str, Column]) -> Column:
    """``domain``, or ``Domain`` only when there is no such column; missing values are "General"."""
    name = next((n for n in ("domain", "Domain") if n in columns), None)
    return F.coalesce(pick(columns, [name] if name else []), F.lit(fixed.DEFAULT_DOMAIN))


def _present(item: Column, key: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", "variant")


def _shown(value: Column) -> Column:
    """A value as text; null and booleans in capitals, as they appear in a Python rendering."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def list_turns(items: Column) -> Column:
    """Structured turns of an ARRAY<VARIANT>: objects by their keys, anything else as text."""

    def turn(item: Column, i: Column) -> Column:
        is_object = F.schema_of_variant(item).startswith("OBJECT")
        speaker = F.coalesce(_present(item, "speaker"), _present(item, "Speaker"))
        text = F.coalesce(_present(item, "text"), _present(item, "Text"))
        return F.struct(
            (i + 1).alias("number"),
            F.when(is_object & speaker.isNotNull(), _shown(speaker)).otherwise("Unknown").alias("speaker"),
            F.when(~is_object, _shown(item))
            .when(text.isNotNull(), _shown(text)).otherwise("").alias("text"),
        )

    return F.transform(items, turn)


def _list_episode(items: Column) -> Column:
    """Struct of ``turns, text, text_with_turns, turn_count`` of a list of turns."""

    def episode(turns: Column) -> Column:
        spoken = F.transform(turns, lambda t: label_turn(t["speaker"], t["text"]))
        return F.struct(
            turns.alias("turns"),
            F.array_join(spoken, "\n").alias("text"),
            number_turns(spoken).alias("text_with_turns"),
            F.size(turns).alias("turn_count"),
        )

    return let(list_turns(items), episode)


def with_episode(rows: DataFrame, raw: str = "conversation") -> DataFrame:
    """Parse the conversation column: ``turns, text, text_with_turns, turn_count, raw_format, error``.

    Text that begins with ``[`` is read as a list, JSON first; only rows that are no JSON are
    tried as a Python literal. Everything else is plain text.
    """
    listed = F.when(strip(F.col(raw)).startswith("["), F.col(raw))
    as_json = "array<variant>"
    items = F.coalesce(F.col("_list"), F.from_json("_literal.json", as_json))
    return (
        rows.withColumn("_list", F.from_json(listed, as_json))
        .withColumn("_literal", python_list_as_json(F.when(F.col("_list").isNull(), listed)))
        .withColumn("_items", items)
        .withColumn("_is_list", F.col("_items").isNotNull())
        .withColumn("_episode", F.when(F.col("_is_list"), _list_episode(F.col("_items")))
                    .otherwise(plain_text_episode(F.col(raw))))
        .select(
            *rows.columns, "_episode.*",
            F.when(F.col("_is_list"), "list").otherwise("str").alias("raw_format"),
            F.col("_literal.error").alias("error"),
        )
    )


def transcripts_of_rows(rows: DataFrame, columns: dict[str, Column], broken: Column | None = None,
                        prefix: Column | None = None, unfinished: Column | None = None) -> LoadedTranscripts:
    """Episodes of raw rows, which have ``row_index`` and, for several files, ``source``.

    ``columns`` maps the names of the header to the cells; ``broken`` marks rows that have too many,
    ``unfinished`` rows whose last quote never closes. A row without an id is named by its position, after
    ``prefix`` if that is given.
    """
    kept = [c for c in ("source",) if c in rows.columns]
    own = pick_id(columns, F.col("row_index"))
    if prefix is not None:
        own = F.when(pick(columns, fixed.ID_COLUMNS).isNull(), F.concat_ws("#", prefix, own)).otherwise(own)
    reason = F.lit(None).cast("string")
    if broken is not None:
        reason = F.when(broken, "more cells than columns")
    if unfinished is not None:
        reason = F.when(unfinished, "unfinished quote").otherwise(reason)
    picked = rows.select(
        *kept, "row_index", reason.alias("reason"), own.alias("id"),
        pick(columns, fixed.CONVERSATION_COLUMNS).alias("conversation"), pick_domain(columns).alias("domain"),
    )
    parsed = with_episode(picked.where("reason is null").drop("reason").where(F.coalesce("conversation", F.lit("")) != ""))
    episodes = parsed.where("error is null").select(
        "id", "text", "text_with_turns", "domain", "turn_count",
        F.struct(*kept, "row_index", "raw_format").alias("metadata"), "turns",
    )
    rejected = (
        picked.where("reason is not null").select(*kept, "row_index", F.col("reason").alias("error"))
        .unionByName(parsed.where("error is not null").select(*kept, "row_index", "error"))
    )
    return LoadedTranscripts(episodes, rejected)


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by their header. Header cells hold no line breaks.

    Numbers rise along a file, so the first line is that of the smallest number; only one line a
    file reaches the driver, which lists the files anyway.
    """
    lines = spark.read.text(path).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    firsts = lines.groupBy("file").agg(F.min_by("value", "at").alias("value")).orderBy("file").collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for file, line in firsts:
        cells = next(csv.reader([line.removeprefix("\ufeff").rstrip("\r")]), [])
        out.setdefault(tuple(cells), []).append(file)
    return out


def _load(spark: SparkSession, paths: str | list[str], names: tuple[str, ...], multi_line: bool,
          several: bool) -> LoadedTranscripts:
    fields = [f"c{i} string" for i in range(len(names))]
    records, _ = split_records(spark, paths, CSV if multi_line else CSV_LINES)
    line = F.regexp_replace("text", r"\r?\n\z|\r\z", "")
    cells = F.from_csv(line, ", ".join([*fields, f"{_OVERFLOW} string"]), _CSV_OPTIONS)
    rows = records.where("at > 0").select(
        "file", (F.col("at") - 1).alias("row_index"), "good", cells.alias("cells")).select("file", "row_index", "good", "cells.*")
    columns = {
        name: F.when(~F.col(f"c{i}").isin(fixed.CSV_NULLS), F.col(f"c{i}"))
        for i, name in reversed(list(enumerate(names)))
    }
    if several:
        rows = rows.withColumnRenamed("file", "source")
    return transcripts_of_rows(
        rows, columns, F.col(_OVERFLOW).isNotNull(), F.col("source") if several else None, ~F.col("good"))


def load_transcripts(spark: SparkSession, path: str, multi_line: bool = True) -> LoadedTranscripts:
    """Read transcripts; empty conversations are skipped, unreadable rows are kept apart.

    Each file is read by its own header; files of equal headers are scanned together. With several
    files, rows name their file in ``metadata`` and in an id that is their position. Cells missing at
    the end of a row are null; a row with more cells than the header has is malformed, which one
    column beyond the header shows. Cells may hold line breaks, and large files are read by many tasks all
    the same; a quote that never closes takes the rest of its file, which is rejected as one row. Without
    ``multi_line`` every line is a row, and those with an odd number of quotes are rejected. Lines end with a
    line feed, before which a carriage return is dropped.
    """
    headers = _headers(spark, path)
    several = sum(map(len, headers.values())) > 1
    if len(headers) <= 1:
        return _load(spark, path, next(iter(headers), ()), multi_line, several)
    parts = [_load(spark, files, names, multi_line, several) for names, files in headers.items()]
    episodes, rejected = parts[0].episodes, parts[0].rejected
    for part in parts[1:]:
        episodes, rejected = episodes.unionByName(part.episodes), rejected.unionByName(part.rejected)
    return LoadedTranscripts(episodes, rejected)
