"""Exact duplicates by two passes of Bloom filtering.

The first pass builds a filter of the slots that at least two rows hit; the second asks it for every
row. Rows that it clears are unique and pass straight through; only the others, which may be repeated,
shuffle and are grouped by their digest. The filter decides how many rows shuffle, never the result.

Defined cases: a null text counts as empty, so all null and empty texts are one group. A null id comes
after every other. Of rows that agree in text and id one stays. Ids are whole numbers. Extra columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from convolens.llm.text import first_missing, normalised
from convolens.scale import keep

SLOTS_PER_ROW = 16
MAX_SLOTS = 1 << 26          # 8 MiB of bits: the bound of what is gathered and broadcast
BLOCK = 1 << 16
PROBES = 2
LAST = (1 << 63) - 1


def digest(text: str) -> Column:
    """SHA-256 of the normalised text."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The slots of each hash, one column per probe."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
    probes = [(low + np.uint64(i) * (high | np.uint64(1))) & np.uint64(slots - 1) for i in range(PROBES)]
    return np.stack(probes, axis=1).astype(np.int64)


def _seen(slots: int):
    """Per task: which slots were hit once, and which at least twice, in blocks of bits."""
    def run(batches):
        hits = np.zeros(slots, np.uint8)
        for batch in batches:
            hashes = np.asarray(batch.column(0)).view(np.uint64)
            # A row that hits a slot with two probes counts once.
            own = np.sort(_slots(hashes, slots), axis=1)
            fresh = np.ones(own.shape, bool)
            fresh[:, 1:] = own[:, 1:] != own[:, :-1]
            slot, times = np.unique(own[fresh], return_counts=True)
            hits[slot] = np.minimum(2, hits[slot] + np.minimum(times, 2).astype(np.uint8))
        for block in np.unique(np.flatnonzero(hits) // BLOCK):
            part = hits[block * BLOCK:(block + 1) * BLOCK]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int32()),
                "once": pa.array([np.packbits(part > 0).tobytes()], pa.binary()),
                "twice": pa.array([np.packbits(part > 1).tobytes()], pa.binary())})
    return run


def _merge(batches):
    """Join the blocks of all tasks, which arrive sorted: hit twice in one task, or in two tasks."""
    block, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_pydict({
            "block": pa.array([block], pa.int32()), "twice": pa.array([twice.tobytes()], pa.binary())})

    for batch in batches:
        for number, a, b in zip(*(column.to_pylist() for column in batch.columns)):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if number == block:
                twice = twice | b | (once & a)
                once = once | a
                continue
            if block is not None:
                yield done()
            block, once, twice = number, a, b
    if block is not None:
        yield done()


def repeated_filter(hashes: DataFrame, column: str, rows: int, max_slots: int = MAX_SLOTS):
    """First pass: a column function that is false only for hashes that occur once.

    The filter has 16 slots a row, at most ``max_slots``: beyond that more rows than need be count as
    possibly repeated. Its bits, a slot each, are all that reaches the driver and is broadcast.
    """
    slots = 1 << 16
    while slots < min(SLOTS_PER_ROW * rows, max_slots):
        slots *= 2
    blocks = (
        hashes.select(column).mapInArrow(_seen(slots), "block int, once binary, twice binary")
        .repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, twice binary"))
    bits = np.zeros(slots // 8, np.uint8)
    for block, twice in blocks.collect():
        bits[block * BLOCK // 8:(block + 1) * BLOCK // 8] = np.frombuffer(twice, np.uint8)
    sent = hashes.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf(T.BooleanType())
    def maybe(values: pd.Series) -> pd.Series:
        place = _slots(values.to_numpy(np.int64).view(np.uint64), slots)
        hit = (sent.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=1))

    return maybe


def _groups(candidates: DataFrame) -> DataFrame:
    """Per digest that really repeats: who stays, and how many rows there are."""
    return keep(
        candidates.groupBy("sha", "id").agg(F.count("*").alias("n"), F.min("tag").alias("tag"))
        .withColumn("ord", F.coalesce("id", F.lit(LAST)))
        .groupBy("sha").agg(
            F.min("id").alias("keep_id"), F.min_by("tag", "ord").alias("keep_tag"),
            F.min_by("n", "ord").alias("ties"), F.sum("n").alias("group_size"))
        .where("group_size > 1"))


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = keep(docs.select(
        F.col(id_column).cast("long").alias("id"), digest(text_column).alias("sha"),
        F.monotonically_increasing_id().alias("tag")).withColumn("h", F.xxhash64("sha")))
    maybe = repeated_filter(digests, "h", digests.count(), max_slots)
    flagged = keep(digests.withColumn("maybe", maybe("h")).drop("h"))
    candidates = flagged.where("maybe").drop("maybe")
    joined = candidates.join(_groups(candidates), "sha", "left").select(
        "id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("tag") == F.col("keep_tag"), F.lit(True)).alias("kept"), "sha")
    alone = flagged.where("NOT maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")
    return joined.union(alone).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    max_slots: int = MAX_SLOTS) -> DataFrame:
    """The documents without those whose text an earlier one has; columns as they are."""
    names = docs.columns
    sha, h, flag, keep_id, ties, size = first_missing(docs, "sha", "h", "maybe", "keep_id", "ties", "group_size")
    digests = keep(docs.select(F.col(id_column).cast("long").alias("id"), digest(text_column).alias("sha"),
                               F.monotonically_increasing_id().alias("tag"))
                   .withColumn("h", F.xxhash64("sha")))
    maybe = repeated_filter(digests, "h", digests.count(), max_slots)
    groups = _groups(digests.where(maybe("h")))
    tied = not groups.where("ties > 1").isEmpty()
    rows = (docs.withColumn(sha, digest(text_column)).withColumn(h, F.xxhash64(sha))
            .withColumn(flag, maybe(h)))
    found = groups.select(F.col("sha").alias(sha), F.col("keep_id").alias(keep_id),
                          F.col("ties").alias(ties), F.col("group_size").alias(size))
    stay = rows.where(flag).join(found, sha, "left").where(
        F.col(size).isNull() | F.col(id_column).cast("long").eqNullSafe(F.col(keep_id)))
    if tied:
        single = F.col(size).isNull() | (F.col(ties) == 1)
        stay = stay.where(single).select(*names).union(
            stay.where(~single).dropDuplicates([sha]).select(*names))
    return stay.select(*names).union(rows.where(~F.col(flag)).select(*names))
