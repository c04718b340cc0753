"""Mixing sources to target weights by pivotal dependent rounding.

Sources share a budget of words by weight; no source gets more than ``max_copies`` times its size, and
what a source leaves goes to the others. A document is then taken a whole number of times: the floor of
its source's ratio plus a copy that is decided by dependent rounding. Two documents with fractional
copies exchange mass, in words, at random until one is decided; the other goes on to the next. So every
document keeps its expected number of copies, and the words of a source leave the target by no more than
half of the last undecided document, which is rounded to the nearer side.

Undecided documents meet in a tree: first within buckets of bounded size, then the one residual of each
bucket with those of its neighbours, level by level. A source of any size is thus spread over many
tasks, and no task holds a group: rows stream past, longest first, so that a long document is decided
against shorter ones and the residual is short.

Every random number is a hash of the row, and buckets depend on the number of rows alone: reruns agree.

Defined cases: a null text counts as empty and has size 0; null is a source of its own, after all
others; rows that agree in id, source and size are one document with repeats and get equal numbers of
copies. Extra columns pass through, an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from convolens.llm.text import first_missing, word_count
from convolens.scale import broadcast_if_small, keep

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_COPIES = 2
BUCKET_ROWS = 2_000
FAN_IN = 16
SEED = 17
MASK = (1 << 64) - 1

UNIT = ("id long, source string, size long, n long, source_size long, target double, base int, p double, "
        "mark long, place long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    schema = T.StructType([*sources.schema, T.StructField("number", T.LongType())])
    return sources.sparkSession.createDataFrame(ordered.map(lambda pair: (*pair[0], pair[1])), schema)


def targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target."""
    sources = keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = keep(
        _ranked(sources).withColumn("weight", F.array(*(F.lit(float(w)) for w in weights))[
            (F.col("number") % len(weights)).cast("int")])
        .withColumn("cap", F.col("source_size") * float(max_copies)))
    words = budget * (sources.agg(F.sum("source_size")).first()[0] or 0)
    # The common level of words per weight rises while sources reach their caps and drop out.
    level, capped_before = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("cap")
        row = sources.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("given"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if row.n == capped_before or not row.weight:
            break
        capped_before = row.n
        level = (words - (row.given or 0.0)) / row.weight
    return keep(sources.select(
        "source", "source_size", F.least("cap", F.col("weight") * level).alias("target")))


def _mixed(mark: int) -> float:
    """A number from 0 to 1 out of a 64-bit mark."""
    z = (mark * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
    return (z ^ z >> 31) / 2.0 ** 64


def exchange(size_a: float, p_a: float, size_b: float, p_b: float, u: float) -> tuple[float, float]:
    """Move mass, in words, between two undecided documents until one of them is decided."""
    to_a, to_b = min(size_a * (1 - p_a), size_b * p_b), min(size_a * p_a, size_b * (1 - p_b))
    moved = to_a if u * (to_a + to_b) < to_b else -to_b
    a, b = p_a + moved / size_a, p_b - moved / size_b
    # The decided end is set exactly.
    if moved > 0:
        return (1.0, b) if size_a * (1 - p_a) <= size_b * p_b else (a, 0.0)
    return (0.0, b) if size_a * p_a <= size_b * (1 - p_b) else (a, 1.0)


def _pivot(level: int):
    """Decide all but at most one row of each run of (source, place); rows arrive sorted by run."""
    def run(batches):
        held, run_of = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                id_, source, size, n, source_size, target, base, p, mark, place = row
                if (source, place) != run_of:
                    if held:
                        out.append(held)
                    held, run_of = None, (source, place)
                row = [id_, source, size, n, source_size, target, base, p, mark, place]
                if p <= 1e-12 or p >= 1 - 1e-12 or not size:
                    # Decided already, or without any words to exchange.
                    row[7] = float(p >= 1 - 1e-12 or (p > 1e-12 and _mixed(mark + level) < p))
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    held[7], row[7] = exchange(held[2] * held[3], held[7], size * n, p, _mixed(mark + level))
                    if held[7] in (0.0, 1.0):
                        out.append(held)
                        held = row
                        if row[7] in (0.0, 1.0):
                            out.append(row)
                            held = None
                    else:
                        out.append(row)
            if out:
                yield _rows(out)
        if held:
            yield _rows([held])
    return run


TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(),
         pa.int64(), pa.int64()]
NAMES = [part.split()[0] for part in UNIT.split(", ")]


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)


def _rounded(units: DataFrame, places: int) -> DataFrame:
    """Decide every unit: within its place, then the residuals of neighbouring places."""
    decided, level = None, 0
    while True:
        stepped = keep(
            units.repartition("source", "place")
            .sortWithinPartitions("source", "place", F.desc(F.col("size") * F.col("n")), "id", "mark")
            .mapInArrow(_pivot(level), UNIT))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done = stepped.where(~open_)
        decided = done if decided is None else decided.union(done)
        units = stepped.where(open_)
        if places == 1:
            break
        places, level = math.ceil(places / FAN_IN), level + 1
        units = units.withColumn("place", F.floor(F.col("place") / FAN_IN))
    # One undecided document a source is left; it goes to the nearer side.
    last = units.withColumn("p", F.round("p"))
    return decided.union(last).select(
        "id", "source", "size", "n", "source_size", "target", (F.col("base") + F.col("p").cast("int")).alias("copies"))


def _shared(units: DataFrame, ratio, places: int) -> DataFrame:
    """Units with the whole and the fractional part of their expected copies."""
    return units.withColumn("ratio", ratio).select(
        "id", "source", "size", "n", "source_size", "target", F.floor("ratio").cast("int").alias("base"),
        (F.col("ratio") - F.floor("ratio")).alias("p"),
        F.xxhash64("id", "source", "size", F.lit(SEED)).alias("mark"),
        F.pmod(F.xxhash64(F.lit(SEED), "size", "id"), F.lit(places)).alias("place"))


def decisions(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_copies: int = MAX_COPIES,
              bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Copies of each distinct (id, source, size), with its source's size and target.

    ``sized``: a kept table of id, source, size.
    """
    goals = broadcast_if_small(targets(sized, weights, budget, max_copies))
    grouped = sized.groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    units = keep(grouped.join(goals, grouped["source"].eqNullSafe(goals["source"])).select(
        "id", grouped["source"], "size", "n", "source_size", "target"))
    places = max(1, math.ceil(units.count() / bucket_rows))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return _rounded(_shared(units, ratio, places), places)


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return keep(docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(source_column).cast("string").alias("source"),
        word_count(text_column).alias("size")))


def mixture(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
            **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    sized = _sized(docs, id_column, text_column, source_column)
    decided = keep(decisions(sized, **options)).select(
        F.col("id").alias("of_id"), F.col("source").alias("of_source"), F.col("size").alias("of_size"),
        "source_size", "target", "copies")
    same = (sized["id"].eqNullSafe(F.col("of_id")) & sized["source"].eqNullSafe(F.col("of_source"))
            & (sized["size"] == F.col("of_size")))
    return sized.join(decided, same).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        **options) -> DataFrame:
    """The documents as often as the mix takes them, columns as they are."""
    of_id, of_source, of_size, copies, copy = first_missing(docs, "of_id", "of_source", "of_size", "copies", "copy")
    decided = keep(decisions(_sized(docs, id_column, text_column, source_column), **options).where("copies > 0").select(
        F.col("id").alias(of_id), F.col("source").alias(of_source), F.col("size").alias(of_size),
        F.col("copies").alias(copies)))
    same = (F.col(id_column).cast("long").eqNullSafe(F.col(of_id))
            & F.col(source_column).cast("string").eqNullSafe(F.col(of_source))
            & (word_count(text_column) == F.col(of_size)))
    # The decisions grow with the documents and are never broadcast, whatever their size here.
    return docs.join(decided.hint("merge"), same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
