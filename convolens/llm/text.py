"""Words, sizes and stable numbers of texts, as columns and for Arrow batches."""

from __future__ import annotations

import ctypes
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 2_000
BATCH_BYTES = "16m"
PIECE_BYTES = 2 << 20


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def normalised(text: str | Column) -> Column:
    """The text with every run of white space as one space."""
    return F.regexp_replace(whole(text), SPACE, " ")


def word_count(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def remainder(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def hashed_sample(keys: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` distinct keys, those of smallest hash; all together no more reach the driver.

    With more keys than that, a share of the hash range is cut first, so that each task gives its share.
    """
    keys = keys.select(key).where(F.col(key).isNotNull()).distinct()
    total = keys.count()
    if total > rows:
        cut = int((1 << 31) * min(1.0, 1.2 * rows / total))
        keys = keys.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < cut)
    return keys.orderBy(F.xxhash64(key), key).limit(rows)


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small batches: by default a batch may hold 64 MB, several times over.

    The setting is read when a query runs, so it stays set for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def pieces(batch: pa.RecordBatch, column: int, size: int = PIECE_BYTES):
    """The batch in runs of rows with up to ``size`` bytes of text, or one row with more; the text is never null."""
    ends, at = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return freed memory to the system, where that can be asked for: workers serve many tasks and would hold on to it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The bytes of a text column of an Arrow batch, nulls as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def first_missing(df: DataFrame, *names: str) -> list[str]:
    """Column names made free of clashes with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
