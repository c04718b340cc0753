"""Records of text files that line ends do not tell: CSV rows with line breaks in cells, items of one JSON list.

A file is read by many tasks. Each reads its block in pieces that end with a certain byte. Whether a piece
ends a record depends on what came before: on being inside quotes, and on the depth of brackets. So a first
pass notes per block what the block does to either beginning, one small row a block is carried along each file,
and a second pass cuts the records from the known beginning. Records that cross blocks are joined from
their parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..scale import BROADCAST_BYTES, broadcast_if_small, footprint, keep

_ESCAPED = re.compile(rb"\\.", re.S)
_ROWS, _BYTES = 1000, 4 << 20


@dataclass(frozen=True)
class Form:
    """``scan(piece, quoted)`` tells whether quotes are open after a piece and how the depth changes.

    A record ends with a piece after which no quote is open and the depth is ``level``. Records that are
    ``blank`` do not count where that is set; ``good`` judges the others.
    """

    scan: Callable[[bytes, bool], tuple[bool, int]]
    level: int
    end: bytes
    skip_blank: bool = False
    good: Callable[[bytes], bool] = lambda record: True


def scan_csv(line: bytes, quoted: bool) -> tuple[bool, int]:
    """Whether a quoted cell stays open. Quotes count only where a cell begins with one."""
    if b'"' not in line:
        return quoted, 0
    at = 0
    while True:
        if quoted or line.startswith(b'"', at):
            at += 0 if quoted else 1
            while True:
                at = line.find(b'"', at)
                if at < 0:
                    return True, 0
                if not line.startswith(b'""', at):
                    break
                at += 2
            quoted = False
        at = line.find(b",", at)
        if at < 0:
            return False, 0
        at += 1


def scan_json(piece: bytes, quoted: bool) -> tuple[bool, int]:
    """Quotes and brackets outside strings. No escape crosses pieces, since none escapes their end."""
    parts = _ESCAPED.sub(b"", piece).split(b'"')
    outside = b"".join(parts[1 if quoted else 0::2])
    opened = outside.count(b"{") + outside.count(b"[") - outside.count(b"}") - outside.count(b"]")
    return quoted ^ (len(parts) % 2 == 0), opened


def _finished(line: bytes) -> bool:
    """An odd quote is half of a cell that goes on in another line, wherever in the line it stands."""
    return line.count(b'"') % 2 == 0


CSV = Form(scan_csv, 0, b"\n", skip_blank=True)
CSV_LINES = Form(lambda line, quoted: (False, 0), 0, b"\n", skip_blank=True, good=_finished)
JSON_LIST = Form(scan_json, 1, b"}")


def _summaries(form: Form):
    """Per block: quotes and depth after it, for both beginnings; the first byte that is no white space."""
    def run(batches):
        key, sides, head = None, None, None

        def out():
            (q0, d0), (q1, d1) = sides
            return pa.RecordBatch.from_pydict({
                "file": pa.array([key[0]]), "block": pa.array([key[1]], pa.int64()),
                "quoted0": pa.array([q0]), "depth0": pa.array([d0], pa.int64()),
                "quoted1": pa.array([q1]), "depth1": pa.array([d1], pa.int64()), "head": pa.array([head], pa.binary())})

        for batch in batches:
            for file, block, value in zip(*(column.to_pylist() for column in batch.columns)):
                if key != (file, block):
                    if key is not None:
                        yield out()
                    key, sides, head = (file, block), [(False, 0), (True, 0)], None
                if head is None:
                    head = value.removeprefix(b"\xef\xbb\xbf").lstrip()[:1] or None
                for side, (quoted, depth) in enumerate(sides):
                    quoted, more = form.scan(value + form.end, quoted)
                    sides[side] = quoted, depth + more
        if key is not None:
            yield out()
    return run


def _carry(batches):
    """Along each file: how every block begins, and which is the last."""
    names = ["file", "block", "quoted", "depth", "first", "last", "head"]
    rows, held, quoted, depth, head = [], None, False, 0, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (
            pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))], names=names)

    for batch in batches:
        for file, block, q0, d0, q1, d1, own in zip(*(column.to_pylist() for column in batch.columns)):
            fresh = held is None or held[0] != file
            if held is not None:
                rows.append((*held[:5], fresh, head))
            if fresh:
                quoted, depth, head = False, 0, None
            # A file begins with its first byte that is no white space.
            held, head = (file, block, quoted, depth, head is None), head or own
            quoted, depth = (q1, depth + d1) if quoted else (q0, depth + d0)
            if len(rows) >= _ROWS:
                yield out()
                rows = []
    if held is not None:
        rows.append((*held[:5], True, head))
        yield out()


def _cut(form: Form):
    """Records and parts of records: n counts those that begin in the block, -1 is what came before."""
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
    names = ["file", "block", "n", "begins", "ends", "good", "closing", "piece"]

    def run(batches):
        rows, size, key, parts = [], 0, None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

        def rest():
            """What the block leaves open. The end of a file is not the end of a piece."""
            text = b"".join(parts).removesuffix(form.end) if last else b"".join(parts)
            if text.strip() or not begins or (last and not form.skip_blank):
                rows.append((*key, n, begins, False, False, last, text))

        for batch in batches:
            for file, block, value, open_, deep, first, final in zip(*(column.to_pylist() for column in batch.columns)):
                if key != (file, block):
                    if key is not None:
                        rest()
                    key, quoted, depth, last, parts = (file, block), open_, deep, final, []
                    begins = first or (not quoted and depth == form.level)
                    n = 0 if begins else -1
                value += form.end
                parts.append(value)
                quoted, more = form.scan(value, quoted)
                depth += more
                if not quoted and depth == form.level:
                    text, parts = b"".join(parts), []
                    if not form.skip_blank or not begins or text.strip():
                        rows.append((*key, n, begins, True, not begins or form.good(text), False, text))
                        size += len(text)
                        n += 1
                    begins = True
                if len(rows) >= _ROWS or (rows and size > _BYTES):
                    yield out()
                    rows, size = [], 0
        if key is not None:
            rest()
        if rows:
            yield out()
    return run


def split_records(spark: SparkSession, paths: str | list[str], form: Form, head: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, at, good, closing, text) of every record, and (file, head) of every file with content.

    With ``head``, only files that begin so are cut into records.

    ``at`` counts the records of a file from 0. A record that does not end lasts to the end of its file
    and is not good; ``closing`` marks what stands there. ``head`` is the first byte that is no white space.
    """
    pieces = spark.read.option("lineSep", form.end.decode()).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("seq"))
    blocks = keep(
        pieces.select("file", "block", "value").mapInArrow(
            _summaries(form), "file string, block long, quoted0 boolean, depth0 long, quoted1 boolean, depth1 long, head binary")
        .repartition("file").sortWithinPartitions("file", "block")
        .mapInArrow(_carry, "file string, block long, quoted boolean, depth long, first boolean, last boolean, head binary"))
    # One small row a block; were they too many to send, the pieces shuffle and are put in order again.
    begun = F.col("head").cast("string")
    wanted = blocks if head is None else blocks.where(begun == head)
    small = footprint(wanted.drop("head")) <= BROADCAST_BYTES
    known = pieces.join(F.broadcast(wanted) if small else wanted, ["file", "block"])
    if not small:
        known = known.repartition("file", "block").sortWithinPartitions("file", "block", "seq")
    parts = keep(known.select("file", "block", "value", "quoted", "depth", "first", "last").mapInArrow(
        _cut(form), "file string, block long, n int, begins boolean, ends boolean, good boolean, closing boolean, piece binary"))
    text = F.col("piece").cast("string")
    whole = parts.where("begins AND ends").select("file", "block", "n", "good", "closing", text.alias("text"))
    along = Window.partitionBy("file").orderBy("block", "n")
    joined = (
        parts.where("NOT (begins AND ends)")
        .withColumn("origin", F.last(F.when(F.col("begins"), F.struct("block", "n")), ignorenulls=True).over(along))
        .groupBy("file", "origin").agg(
            F.max("ends").alias("good"), F.max("closing").alias("closing"),
            F.sort_array(F.collect_list(F.struct("block", "n", text.alias("piece")))).alias("pieces"))
        .select("file", "origin.block", "origin.n", "good", "closing", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keep(
        parts.where("begins").groupBy("file", "block").agg(F.count("*").alias("own"))
        .select("file", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset")))
    records = whole.union(joined).join(broadcast_if_small(offsets), ["file", "block"]).select(
        "file", (F.col("offset") + F.col("n")).alias("at"), "good", "closing", "text")
    return records, blocks.where("last AND head IS NOT NULL").select("file", begun.alias("head"))


_ITEMS = "array<variant>"
_SPAN = 4096


def list_items(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, pos, item) of JSON lists, positions counting from 0 in each file; (file, pos, error) of what cannot be read.

    A record holds an object and what stands between it and the object before it, and is read as a list of
    its own, so one that is broken leaves the others as they are.
    """
    blanks = F.lit(" \t\r\n\ufeff")

    def tail(text):
        return F.btrim(F.substring(text, 2, 2**31 - 1), blanks)

    first, body = F.col("at") == 0, F.btrim(F.col("text"), blanks)
    opened = F.when(~first, body).when(body.startswith("["), tail(body))
    closed = F.when(~F.col("closing"), opened).when(
        opened.endswith("]"), F.btrim(F.substring(opened, F.lit(1), F.char_length(opened) - 1), blanks))
    rows = records.withColumn("body", closed).withColumn("inner", F.when(first | (F.col("body") == ""), F.col("body")).when(
        F.col("body").startswith(",") & (tail(F.col("body")) != ""), tail(F.col("body"))))
    # A record that begins with an object is that object; only others can hold more or fewer items than one.
    single = F.coalesce(F.col("inner").startswith("{"), F.lit(False)) & ~F.col("closing")
    listed = rows.select("file", "at", "closing", single.alias("single"), F.from_json(
        F.concat(F.lit("["), "inner", F.lit("]")), _ITEMS).alias("items"))
    odd = listed.where(~F.col("single") & ~F.col("closing")).select(
        "file", "at", (F.coalesce(F.size("items"), F.lit(1)) - 1).alias("more"))
    if odd.isEmpty():
        listed = listed.withColumn("before", F.lit(0))
    else:
        # How many items more than records came before: within spans of records, then over the spans.
        span = F.floor(F.col("at") / _SPAN)
        in_span = Window.partitionBy("file", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        over = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        numbers = records.select("file", "at").join(odd, ["file", "at"], "left").withColumn("span", span)
        spans = numbers.groupBy("file", "span").agg(F.sum("more").alias("more")).select(
            "file", "span", F.coalesce(F.sum("more").over(over), F.lit(0)).alias("earlier"))
        shifts = keep(
            numbers.withColumn("own", F.coalesce(F.sum("more").over(in_span), F.lit(0))).join(spans, ["file", "span"])
            .select("file", "at", (F.col("own") + F.col("earlier")).alias("before")))
        listed = listed.join(shifts, ["file", "at"])
    start = F.col("at") + F.col("before")
    rejected = listed.where("items is null").select("file", start.alias("pos"), F.when(
        F.col("closing"), "the list does not end").otherwise("no valid JSON").alias("error"))
    found = listed.select("file", start.alias("start"), F.posexplode_outer("items").alias("i", "item")).where("i is not null")
    return found.select("file", (F.col("start") + F.col("i")).alias("pos"), "item"), rejected
