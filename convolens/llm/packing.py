"""Packing documents into sequences: length patterns fitted by non-negative least squares.

Texts become token ids, with an end id after each; only documents longer than a sequence are cut. The
histogram of piece lengths, which has at most as many entries as a sequence has tokens, goes to the
driver. There all patterns of up to three lengths that fill a sequence exactly are enumerated, and
repeat counts are fitted to the histogram by non-negative least squares (accelerated projected
gradient). Counts are rounded at random by their fractions, with a fixed seed, and never use more
pieces than there are; the pieces left over are packed best fit first, longest first, as counts of
equal sequences. The plan is a list of patterns with counts, bounded by the number of patterns. The
pieces then find their place by their rank among those of equal length, which is counted in buckets.

Defined cases: a null text counts as empty, a piece of the end id alone. Rows that repeat are packed as
often as they occur. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from convolens.llm.text import bounded_batches
from convolens.scale import keep

SEQUENCE = 2048
END = 0
ITERATIONS = 400
SEED = 11
BUCKET_ROWS = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def load_encoder(path: str | None = None):
    """A function from texts to ids by the vocabulary file of a byte-level BPE tokenizer.

    The merges of such a file are in the order of the ids they make, so ids serve as merge ranks. The fast
    library gives up on texts with very long runs of white space; those go to the file's own library.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        spec = json.load(file)
    # Byte-level files write every byte as a printable character; the others follow from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens=special)
    exact = []

    def encode(text):
        try:
            return encoding.encode(text, allowed_special="all") if special else encoding.encode_ordinary(text)
        except ValueError:
            if not exact:
                exact.append(Tokenizer.from_file(path or default_vocabulary()))
            return exact[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(length: int, limit: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the limit."""
    first = length if length <= limit else length % limit or limit
    return [(0, first)] + [(start, limit) for start in range(first, length, limit)]


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None,
           limit: int = SEQUENCE) -> DataFrame:
    """The pieces of all documents, with the checksum of their ids."""
    def run(batches):
        encode = load_encoder(vocabulary)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), END], "<u4")
                out += [(doc, number, start, size, zlib.crc32(ids[start:start + size]))
                        for number, (start, size) in enumerate(cut(len(ids), limit))]
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column).mapInArrow(run, PIECES)


def patterns(present: np.ndarray, limit: int) -> np.ndarray:
    """All sorted choices of one to three present lengths that sum to the limit; 0 fills up."""
    there = np.zeros(limit + 1, bool)
    there[present] = True
    found = [np.array([[limit, 0, 0]])] if there[limit] else []
    small = present[present <= limit // 2]
    pairs = small[there[limit - small]]
    found.append(np.stack([pairs, limit - pairs, 0 * pairs], axis=1))
    for a in present[present <= limit // 3]:
        b = present[(present >= a) & (present <= (limit - a) // 2)]
        b = b[there[limit - a - b]]
        found.append(np.stack([np.full_like(b, a), b, limit - a - b], axis=1))
    return np.concatenate(found).astype(np.int64)


def fit(parts: np.ndarray, histogram: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative repeat counts x that bring the lengths used by the patterns close to the histogram."""
    size = len(histogram)

    def used(x):
        return np.bincount(parts.ravel(), np.repeat(x, 3), size)

    def back(r):
        return r[parts].sum(axis=1)

    # Lengths are scaled so that rare ones count as much as common ones.
    scale = 1 / np.maximum(histogram, 1.0)
    scale[0] = 0.0
    probe = np.ones(len(parts))
    for _ in range(20):
        probe = back(scale * used(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(iterations):
        step = np.maximum(0.0, y - back(scale * (used(y) - histogram)) / (1.05 * norm))
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        x, y, t = step, step + (t - 1) / after * (step - x), after
    return x


def best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack the remaining pieces, longest first, each where least space stays; equal sequences as one."""
    groups, at = defaultdict(list), np.zeros(limit + 1, bool)

    def put(content, count):
        space = limit - sum(content)
        groups[space].append((content, count))
        at[space] = True

    for size in range(limit, 0, -1):
        n = int(left[size])
        while n:
            fitting = np.flatnonzero(at[size:])
            if len(fitting):
                space = size + int(fitting[0])
                content, count = groups[space].pop()
                taken = min(n, count)
                if taken < count:
                    groups[space].append((content, count - taken))
                at[space] = bool(groups[space])
                put((*content, size), taken)
                n -= taken
                continue
            each = limit // size
            if n >= each:
                put((size,) * each, n // each)
            if n % each:
                put((size,) * (n % each), 1)
            n = 0
    return [group for found in groups.values() for group in found]


def plan(histogram: np.ndarray, limit: int = SEQUENCE, seed: int = SEED) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), using every piece of the histogram once."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    present = np.flatnonzero(left)
    if not len(present):
        return []
    out = []
    parts = patterns(present, limit)
    if len(parts):
        x = fit(parts, left.astype(float))
        counts = np.floor(x + np.random.default_rng(seed).random(len(x))).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if not counts[i]:
                continue
            content = tuple(int(p) for p in parts[i] if p)
            count = min(int(counts[i]), *(int(left[p]) // content.count(p) for p in content))
            if count:
                for p in content:
                    left[p] -= count
                out.append((content, count))
    return out + best_fit(left, limit)


def slots(planned, limit: int = SEQUENCE):
    """The plan by length: for pieces of a length, from which rank on which sequences and offset hold.

    Arrays of (length and first rank as one key, first sequence, offset), sorted by key.
    """
    rank, rows, sequence = np.zeros(limit + 1, np.int64), [], 0
    for content, count in planned:
        offset = 0
        for size in content:
            rows.append((size << 44 | int(rank[size]), sequence, offset))
            rank[size] += count
            offset += size
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None,
         limit: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = keep(pieces(docs, id_column, text_column, vocabulary, limit))
    histogram = np.zeros(limit + 1, np.int64)
    for row in cuts.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    sent = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, limit), limit))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, sequences, offsets = sent.value
        key = length.to_numpy(np.int64) << 44 | rank.to_numpy(np.int64)
        run = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[run] + key - keys[run], "offset": offsets[run]})

    buckets = max(1, math.ceil(int(histogram.sum()) / BUCKET_ROWS))
    filed = cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = keep(filed.groupBy("length", "bucket").count().withColumn("before", F.coalesce(
        F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("count"))
    ranked = filed.withColumn("rank", F.row_number().over(
        Window.partitionBy("bucket", "length").orderBy("doc_id", "piece")) - 1)
    return ranked.join(before, ["bucket", "length"]).withColumn(
        "p", place("length", F.col("before") + F.col("rank"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")
