"""Exact search for the largest inner products by norm-bucketed retrieval.

Vectors become whole numbers, floor(scale * x). They are dealt out by descending length and cut into
buckets of similar length. A query's k-th best product among the longest buckets is its first threshold.
It needs no bucket whose longest vector could not reach the threshold at cosine one. In every other
bucket the threshold gives a local cosine threshold, which chooses the pruning:

- low: by length, only vectors at least threshold / query length long can qualify;
- high: by coordinate, a vector within the threshold's angle of the query lies in a known range in each
  of the query's largest coordinates; sorted columns of the bucket give the rows of the narrowest range,
  the other ranges thin them out.

What is left is verified by its exact product. Bounds have slack for rounding, so no tie is lost.
Queries go out in blocks of similar need, and each block reads only the buckets that it needs. Buckets
and query blocks are of bounded size whatever the widths and however many vectors are alike.

Defined cases: a vector that is null or holds null or non-finite components takes no part, nor does one
without id. Zero and empty vectors do. Vectors of different widths meet in the components that both have.
Repeated rows are candidates each, but a row with the query's own id is none; of query rows with equal
ids the smallest vector asks. Numbers beyond a long are cut to its range; sums are exact as long as they
fit a long. Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from convolens.scale import keep, shared_path

BUCKET_ROWS = 2048
BUCKET_BYTES = 4 << 20
LEAST_ROWS = 64              # a bucket is cut for length only from this size
ALIKE = 0.9                  # of the bucket's longest vector
SEED_BUCKETS = 4
QUERY_ROWS = 4096
QUERY_BYTES = 16 << 20
FOCUS = 3                    # coordinates asked per query
HIGH_COSINE = 0.35           # from this local threshold on, prune by coordinate
CHUNK = 256
SLACK = 1e-9
EXACT = float(1 << 53)
BUCKETS = "top double, width int, ids binary, lengths binary, vectors binary"
FOUND = "query_id long, rank int, vec_id long, score long"


def integers(vectors: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """id, v (array of long) and norm of the vectors that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"),
                          F.col(vector_column).cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    finite = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = finite.select("id", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    return whole.withColumn("norm", F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))))


def padded(column: pa.Array) -> np.ndarray:
    """One row of whole numbers per list, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _pack(batches):
    """Rows that arrive by descending length, one bucket a row."""
    ids, lengths, rows = [], [], []

    def bucket():
        width = max(map(len, rows))
        matrix = np.zeros((len(rows), width), np.int64)
        for place, row in enumerate(rows):
            matrix[place, :len(row)] = row
        return pa.RecordBatch.from_pydict({
            "top": pa.array([lengths[0]]), "width": pa.array([width], pa.int32()),
            "ids": pa.array([np.array(ids, np.int64).tobytes()]), "lengths": pa.array([np.array(lengths).tobytes()]),
            "vectors": pa.array([matrix.tobytes()])})

    size = 0
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        values = np.split(batch.column(1).flatten().to_numpy(), np.cumsum(sizes)[:-1]) if len(sizes) else []
        for i, v, norm in zip(batch.column(0).to_pylist(), values, batch.column(2).to_pylist()):
            size = max(size, len(v))
            if rows and (len(rows) >= BUCKET_ROWS or 8 * size * (len(rows) + 1) > BUCKET_BYTES
                         or (len(rows) >= LEAST_ROWS and norm < ALIKE * lengths[0])):
                yield bucket()
                ids, lengths, rows, size = [], [], [], len(v)
            ids.append(i)
            lengths.append(norm)
            rows.append(v)
    if rows:
        yield bucket()


class Bucket:
    """The vectors of one bucket, longest first, with sorted columns made when first asked for."""

    def __init__(self, top: float, width: int, ids: bytes, lengths: bytes, vectors: bytes):
        self.top = top
        self.ids, self.lengths = np.frombuffer(ids, np.int64), np.frombuffer(lengths)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(len(self.ids), width)
        self.largest = np.abs(self.vectors.astype(float)).max(initial=0.0)
        self.as_float = self.vectors.astype(float)
        self.units = self.as_float / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by ascending unit coordinate, and those coordinates."""
        if f not in self.columns:
            order = np.argsort(self.units[:, f], kind="stable")
            self.columns[f] = order, self.units[order, f]
        return self.columns[f]

    def products(self, queries: np.ndarray, rows=slice(None)) -> np.ndarray:
        """Exact inner products, a row per query."""
        width = min(queries.shape[1], self.vectors.shape[1])
        asked = queries[:, :width]
        if width * self.largest * np.abs(asked.astype(float)).max(initial=0.0) < EXACT:
            return (asked.astype(float) @ self.as_float[rows, :width].T).astype(np.int64)
        return asked @ self.vectors[rows, :width].T


def feasible(cosine: float, coordinate: float) -> tuple[float, float]:
    """Where a unit vector's coordinate lies if its product with a unit query of that coordinate is at least ``cosine``."""
    own, angle = math.acos(max(-1.0, min(1.0, coordinate))), math.acos(max(-1.0, min(1.0, cosine)))
    return math.cos(min(math.pi, own + angle)) - SLACK, math.cos(max(0.0, own - angle)) + SLACK


class Search:
    """The k best products of a block of queries among the buckets seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.limits = limits.copy()
        as_float = queries.astype(float)
        self.norms = np.sqrt((as_float ** 2).sum(axis=1))
        self.units = as_float / np.where(self.norms > 0, self.norms, 1.0)[:, None]
        self.focus = np.argsort(-np.abs(self.units), axis=1, kind="stable")[:, :FOCUS]
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
        self.by_length = self.by_coordinate = self.verified = 0

    def add(self, bucket: Bucket) -> None:
        with np.errstate(invalid="ignore"):
            reach = self.norms * bucket.top
            active = np.flatnonzero(self.limits <= reach * (1 + SLACK))
            local = np.where((self.limits > 0) & (reach > 0), self.limits / np.where(reach > 0, reach, 1.0), -1.0)
        high = local[active] >= HIGH_COSINE
        self._lengths(bucket, active[~high])
        for q in active[high]:
            self._coordinates(bucket, q, local[q] * (1 - SLACK))

    def _needed(self, q) -> float:
        return self.limits[q] / self.norms[q] * (1 - SLACK) if self.limits[q] > 0 and self.norms[q] > 0 else -1.0

    def _lengths(self, bucket: Bucket, asked: np.ndarray) -> None:
        self.by_length += len(asked)
        for at in range(0, len(asked), CHUNK):
            part = asked[at:at + CHUNK]
            ends = [int(np.searchsorted(-bucket.lengths, -self._needed(q), side="right")) for q in part]
            products = bucket.products(self.queries[part], slice(0, max(ends)))
            for q, end, row in zip(part, ends, products):
                self.verified += end
                self._take(q, row[:end], bucket.ids[:end])

    def _coordinates(self, bucket: Bucket, q: int, cosine: float) -> None:
        self.by_coordinate += 1
        ranges = []
        for f in self.focus[q]:
            if f >= bucket.units.shape[1]:
                continue
            low, high = feasible(cosine, self.units[q, f])
            order, values = bucket.column(f)
            first, last = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
            ranges.append((last - first, first, last, f, low, high, order))
        if ranges:
            ranges.sort(key=lambda r: r[0])
            _, first, last, _, _, _, order = ranges[0]
            rows = order[first:last]
            for _, _, _, f, low, high, _ in ranges[1:]:
                values = bucket.units[rows, f]
                rows = rows[(values >= low) & (values <= high)]
        else:
            rows = np.arange(len(bucket.ids))
        rows = rows[bucket.lengths[rows] >= self._needed(q)]
        if len(rows):
            self.verified += len(rows)
            self._take(q, bucket.products(self.queries[q:q + 1], rows)[0], bucket.ids[rows])

    def _take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.limits[q]) & (ids != self.ids[q])
        if not good.any():
            return
        scores = np.concatenate([self.best[q][0], scores[good]])
        ids = np.concatenate([self.best[q][1], ids[good]])
        order = np.lexsort((ids, ~scores))[:self.k]      # ~ instead of -: the least long has no negative
        self.best[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.limits[q] = max(self.limits[q], lowered(scores[order[-1]]))

    def found(self) -> pa.RecordBatch:
        sizes = [len(ids) for _, ids in self.best]
        return pa.RecordBatch.from_pydict({
            "query_id": pa.array(np.repeat(self.ids, sizes)),
            "vec_id": pa.array(np.concatenate([np.empty(0, np.int64), *(ids for _, ids in self.best)])),
            "score": pa.array(np.concatenate([np.empty(0, np.int64), *(scores for scores, _ in self.best)]))})


def lowered(score) -> float:
    """A score as threshold: never above it, however it is rounded."""
    return float(score) - abs(float(score)) * 1e-12


def buckets_of(batch: pa.RecordBatch):
    for values in zip(*(column.to_pylist() for column in batch.columns)):
        yield Bucket(*values)


def _with_limits(sent, k: int):
    """Each query's k-th best product among the longest buckets, and the length a vector needs to reach it."""
    def run(batches):
        seeds = [Bucket(*row) for row in sent.value]
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, queries = part.column(0).to_numpy(), padded(part.column(1))
                search = Search(ids, queries, np.full(len(ids), -np.inf), k)
                for seed in seeds:
                    search.add(seed)
                needs = np.array([search._needed(q) for q in range(len(ids))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(search.limits), pa.array(needs)], ["id", "v", "floor", "need"])
    return run


def _blocks(queries: DataFrame, rows: int) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Queries with a block of about ``rows`` of similar need; the blocks with the least need of each."""
    total = queries.count()
    levels = math.ceil(total / rows)
    level = F.lit(0)
    if levels > 1:
        cuts = sorted(set(queries.approxQuantile("need", [i / levels for i in range(1, levels)], 0.25 / levels)))
        level = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col("need")))
    queries = queries.withColumn("level", level)
    # Queries of equal need share a level; a hash splits it.
    parts = {r["level"]: math.ceil(r["n"] / rows) for r in queries.groupBy("level").agg(F.count("*").alias("n")).collect()}
    if max(parts.values(), default=1) > 1:
        split = F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("level"))
        queries = queries.withColumn("part", F.pmod(F.xxhash64("id"), split).cast("int"))
    else:
        queries = queries.withColumn("part", F.lit(0))
    queries = keep(queries)
    blocks = queries.groupBy("level", "part").agg(F.min("need").alias("need")).orderBy("level", "part").collect()
    return queries, [((b["level"], b["part"]), b["need"]) for b in blocks]


def top_products(vectors: DataFrame, asks: Column, k: int = 5, id_column: str = "vec_id",
                 vector_column: str = "embedding", scale: float = 256.0, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row that ``asks`` with other rows.

    ``asks`` is a condition on the column ``id``. Of equal products the smaller id comes first.
    """
    spark = vectors.sparkSession
    rows = keep(integers(vectors, id_column, vector_column, scale))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    # Equally long vectors split by id, rows that agree in both by a number.
    dealt = rows.withColumn("tag", F.monotonically_increasing_id())
    buckets = keep(
        dealt.repartitionByRange(F.desc("norm"), "id", "tag").sortWithinPartitions(F.desc("norm"), "id", "tag")
        .select("id", "v", "norm").mapInArrow(_pack, BUCKETS))
    # At most SEED_BUCKETS buckets of at most BUCKET_BYTES each (or one vector) pass through the driver.
    longest = [tuple(r) for r in buckets.orderBy(F.desc("top")).limit(SEED_BUCKETS).collect()]
    seeds = spark.sparkContext.broadcast(longest)
    asked = rows.where(asks).groupBy("id").agg(F.min("v").alias("v"))
    queries, blocks = _blocks(
        keep(asked.mapInArrow(_with_limits(seeds, k), "id long, v array<long>, floor double, need double")),
        max(1, min(query_rows, QUERY_BYTES // (8 * width))))
    if not blocks:
        return spark.createDataFrame([], FOUND)
    path = shared_path(spark, "products")
    for (level, part), need in blocks:
        block = queries.where((F.col("level") == level) & (F.col("part") == part)).select("id", "v", "floor").toArrow()
        block = block.combine_chunks().to_batches()[0]
        sent = spark.sparkContext.broadcast((block.column(0).to_numpy(), padded(block.column(1)), block.column(2).to_numpy()))

        def run(batches, sent=sent):
            search = Search(*sent.value, k)
            for batch in batches:
                for bucket in buckets_of(batch):
                    search.add(bucket)
            yield search.found()

        candidates = buckets.where(F.col("top") >= need).mapInArrow(run, "query_id long, vec_id long, score long")
        ranked = candidates.withColumn("rank", F.row_number().over(
            Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(FOUND).parquet(path)
