"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

Vectors are centred, scaled to length one and rotated at random; the signs are the code, packed into
bits. The inner product of a vector with a query is estimated from the signs and a correction scalar,
the product of the vector with its own code; the error is bounded with high probability by the part of
the vector that the code misses. A vector is compared exactly only if its lower bound for the distance
does not exceed the best known k-th distance of the query. Every row is indexed and every query meets
every code: queries go out in blocks of bounded size, and each task keeps k candidates a query.

The centre comes from at most ``SAMPLE_ROWS`` vectors, chosen by a hash of their id.

Defined cases: a vector that is null, zero, of another length than most, or with a null or non-finite
component takes no part, nor does one without id. Of query rows with equal ids the smallest vector asks;
a row with the query's own id is no candidate of it. Extra columns are ignored, an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from convolens.llm.text import hashed_sample
from convolens.scale import keep

SAMPLE_ROWS = 10_000
QUERY_BLOCK = 4096
CHUNK = 2048
ERROR_FACTOR = 3.0
SEED = 23


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v (array of double) of the vectors that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"),
                          F.col(vector_column).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    good = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("v", lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("v") == (common["n"] if common else 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def encode(v: np.ndarray, centre: np.ndarray, rotated: np.ndarray):
    """Packed signs, distance from the centre, and product with the own code, of each row."""
    shifted = v - centre
    length = np.linalg.norm(shifted, axis=1)
    unit = shifted @ rotated / np.where(length > 0, length, 1.0)[:, None]
    own = np.abs(unit).sum(axis=1) / math.sqrt(v.shape[1])
    return np.packbits(unit > 0, axis=1), length, np.where(length > 0, own, 1.0)


def index(rows: DataFrame, centre: np.ndarray, rotated: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bits, length, own = encode(matrix(batch.column(1), len(centre)), centre, rotated)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(own),
                    batch.column(1)], ["id", "code", "length", "own", "v"])

    return rows.mapInArrow(run, "id long, code binary, length double, own double, v array<double>")


def bounds(bits: np.ndarray, length: np.ndarray, own: np.ndarray, turned: np.ndarray, asked_length: np.ndarray,
           factor: float = ERROR_FACTOR) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances; ``turned``: unit queries after rotation, a row each."""
    width = turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=width).astype(np.float32) * 2 - 1
    product = (turned.astype(np.float32) @ signs.T) / (math.sqrt(width) * own)
    error = factor * np.sqrt(np.maximum(0.0, 1 - own ** 2)) / (own * math.sqrt(max(1, width - 1)))
    middle = length ** 2 + asked_length[:, None] ** 2 - 2 * length * asked_length[:, None] * product
    spread = 2 * length * asked_length[:, None] * error + 1e-5 * (length ** 2 + asked_length[:, None] ** 2)
    return middle - spread, middle + spread


class Search:
    """The k best candidates of a block of queries among the rows seen so far."""

    def __init__(self, ids, queries, centre, rotated, k, factor=ERROR_FACTOR):
        self.ids, self.queries, self.k, self.factor = ids, queries, k, factor
        shifted = queries - centre
        self.length = np.linalg.norm(shifted, axis=1)
        self.turned = shifted @ rotated / np.where(self.length > 0, self.length, 1.0)[:, None]
        self.best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        self.limit = np.full(len(ids), np.inf)
        self.compared = 0

    def add(self, ids, bits, length, own, v):
        low, high = bounds(bits, length, own, self.turned, self.length, self.factor)
        high[self.ids[:, None] == ids] = np.inf
        limit = self.limit
        if len(ids) >= self.k:
            limit = np.minimum(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        for q in np.flatnonzero((low <= limit[:, None]).any(axis=1)):
            chosen = np.flatnonzero((low[q] <= limit[q]) & (ids != self.ids[q]))
            self.compared += len(chosen)
            squared = ((v[chosen] - self.queries[q]) ** 2).sum(axis=1)
            squared, found = np.concatenate([self.best[q][0], squared]), np.concatenate([self.best[q][1], ids[chosen]])
            order = np.lexsort((found, squared))[:self.k]
            self.best[q] = squared[order], found[order]
            if len(order) == self.k:
                # Slack for the bounds' own rounding, so that ties are compared.
                self.limit[q] = squared[order[-1]] * (1 + 1e-9)

    def rows(self):
        for q, (squared, found) in zip(self.ids.tolist(), self.best):
            for d, i in zip(np.sqrt(squared).tolist(), found.tolist()):
                yield q, i, d


def nearest(vectors: DataFrame, asks: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
            query_block: int = QUERY_BLOCK, factor: float = ERROR_FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest rows of each row that ``asks``.

    ``asks`` is a condition on the column ``id``.
    """
    rows = usable(vectors, id_column, vector_column)
    # At most SAMPLE_ROWS ids, and one vector of each.
    sample = rows.join(F.broadcast(hashed_sample(rows, "id", SAMPLE_ROWS)), "id").groupBy("id").agg(
        F.min("v").alias("v")).orderBy("id").select("v").toArrow()["v"].combine_chunks()
    width = len(sample[0]) if len(sample) else 1
    centre = matrix(sample, width).mean(axis=0) if len(sample) else np.zeros(1)
    rotated = rotation(width)
    codes = keep(index(rows, centre, rotated))
    queries = codes.where(asks).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, math.ceil(queries.count() / query_block))
    queries = keep(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    found = []
    for block in range(blocks):
        # About query_block vectors at a time pass through the driver to the tasks.
        asked = queries.where(F.col("block") == block).orderBy("id").select("id", "v").toArrow()
        if not asked.num_rows:
            continue
        sent = codes.sparkSession.sparkContext.broadcast((
            asked["id"].to_numpy(), matrix(asked["v"].combine_chunks(), width)))

        def run(batches, sent=sent):
            search = Search(*sent.value, centre, rotated, k, factor)
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    bits = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    search.add(part.column(0).to_numpy(), bits, part.column(2).to_numpy(), part.column(3).to_numpy(),
                               matrix(part.column(4), width))
            out = list(zip(*search.rows())) or [[], [], []]
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                "score": pa.array(out[2], pa.float64())})

        candidates = codes.mapInArrow(run, "query_id long, vec_id long, score double")
        ranked = candidates.withColumn("rank", F.row_number().over(
            Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
        found.append(keep(ranked.select("query_id", "rank", "vec_id", "score")))
    if not found:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    result = found[0]
    for part in found[1:]:
        result = result.union(part)
    return result
