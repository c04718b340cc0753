import numpy as np
from pyspark.sql import functions as F

from convolens.llm import neighbours
from convolens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score double, v int"


def slow(rows, k):
    size = max((len(v) for _, v in rows), key=[len(v) for _, v in rows].count)
    out = {}
    for q, a in sorted(rows, key=lambda r: r[1], reverse=True):
        if q % 100 == 0 and len(a) == size:
            near = sorted((float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), i)
                          for i, b in rows if i != q and len(b) == size)[:k]
            out[q] = [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return [r for q in sorted(out) for r in out[q]]


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    good = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(60)] + [(100, [1.0] * 8), (200, [1.0] * 8), (7, [1.0] * 8)]
    good += [(300, [2.0] * 8), (300, [2.0] * 8)]
    bad = [(400, None), (401, [0.0] * 8), (500, [float("nan")] + [1.0] * 7), (402, [float("inf")] + [1.0] * 7),
           (403, [None] + [1.0] * 7), (404, [1.0] * 5), (None, [1.0] * 8), (405, [])]
    frame = spark.createDataFrame([(*row, 1.0, 1) for row in good + bad], SCHEMA).repartition(3)
    asks = F.col("id") % 100 == 0
    for k, block in ((10, 4096), (10, 1), (500, 4096)):
        got = neighbours.nearest(frame, asks, k=k, query_block=block).orderBy("query_id", "rank").collect()
        expected = slow(good, k)
        assert [(x.query_id, x.rank, x.vec_id) for x in got] == [x[:3] for x in expected]
        assert np.allclose([x.score for x in got], [x[3] for x in expected], rtol=1e-12)
    assert neighbours.nearest(frame.limit(0), asks).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 100"), asks).count() == 0


def test_bounds_hold_and_spare_work():
    r = np.random.default_rng(2)
    v, q = r.normal(size=(3000, 64)), r.normal(size=(20, 64))
    centre, rotated = v.mean(axis=0), neighbours.rotation(64)
    assert np.allclose(rotated @ rotated.T, np.eye(64))
    bits, length, own = neighbours.encode(v, centre, rotated)
    assert bits.shape == (3000, 8)
    search = neighbours.Search(np.arange(20) - 100, q, centre, rotated, 10)
    low, high = neighbours.bounds(bits, length, own, search.turned, search.length)
    exact = ((q[:, None, :] - v) ** 2).sum(axis=2)
    assert ((low <= exact) & (exact <= high)).mean() > 0.995
    for at in range(0, 3000, 500):
        search.add(np.arange(at, at + 500), bits[at:at + 500], length[at:at + 500], own[at:at + 500], v[at:at + 500])
    assert search.compared < 0.6 * exact.size


def test_query_recall(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    expected = {x[0:1] + x[2:3] for x in slow(rows, 10)}
    got = {(r.query_id, r.vec_id) for r in QUERIES["op5_nearest_neighbours"][0](spark, folder).collect()}
    assert len(got & expected) / len(expected) >= 0.95 and len(got) == len(expected)
