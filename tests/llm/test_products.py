import numpy as np
import pytest
from pyspark.sql import functions as F

from convolens.llm import products
from convolens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, score double, v int, norm string"


def slow(rows, k, every):
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    out, seen = [], set()
    for q, a in sorted(whole):
        if q % every == 0 and q not in seen:
            seen.add(q)
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def got(frame, k=5, **options):
    found = products.top_products(frame, F.col("id") % 50 == 0, k=k, **options)
    return [tuple(r) for r in found.orderBy("query_id", "rank").collect()]


def test_odd_rows(spark):
    r = np.random.default_rng(5)
    good = [(i, (r.normal(size=6) * 10.0 ** r.integers(-3, 3)).tolist()) for i in range(150)]
    good += [(200, [0.0] * 6), (250, []), (300, [1.0, -1.0]), (350, [2.0] * 9), (350, [1.0] * 6), (400, [-5.0] * 6)]
    good += [(500 + i, [3.0] * 6) for i in range(30)] + [(7, [3.0] * 6), (7, [3.0] * 6)]
    bad = [(450, None), (451, [float("nan")] * 6), (452, [float("inf")] + [1.0] * 5), (453, [None] + [1.0] * 5), (None, [9.0] * 6)]
    frame = spark.createDataFrame([(*row, 1.0, 1, "x") for row in good + bad], SCHEMA).repartition(3)
    for k, rows in ((5, 4096), (5, 2), (500, 4096)):
        assert got(frame, k, query_rows=rows) == slow(good, k, 50)
    assert got(frame.limit(0)) == []
    assert got(frame.where("vec_id = 200")) == []


def test_products_beyond_floats(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.integers(-(1 << 20), 1 << 20, size=4)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(frame) == slow(rows, 5, 50)


@pytest.mark.parametrize("kind", ["spread", "alike", "clustered", "repeated"])
def test_equals_all_products(spark, kind, monkeypatch):
    r = np.random.default_rng(7)
    v = r.normal(size=(1500, 16))
    if kind == "spread":
        v *= np.exp(r.normal(size=(1500, 1)) * 2)
    elif kind == "alike":
        v /= np.linalg.norm(v, axis=1)[:, None]
    elif kind == "clustered":
        v = np.repeat(v[:100], 15, axis=0) + 0.05 * v
    else:
        v[200:900] = v[0]
    rows = list(enumerate(v.tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert got(frame) == slow(rows, 5, 50)


def test_both_prunings_spare_products():
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 16))
    v = np.floor(256 * (np.repeat(centres, 30, axis=0) + 0.1 * r.normal(size=(1800, 16)))).astype(np.int64)
    norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms)
    parts = [order[at:at + 300] for at in range(0, 1800, 300)]
    buckets = [products.Bucket(norms[p[0]], 16, p.tobytes(), norms[p].tobytes(), v[p].tobytes()) for p in parts]
    asked = np.arange(0, 1800, 50)
    search = products.Search(asked, v[asked], np.full(len(asked), -np.inf), 5)
    for bucket in buckets:
        search.add(bucket)
    assert search.by_length > 0 and search.by_coordinate > 0
    assert search.verified < 0.6 * len(asked) * len(v)
    for q, (scores, ids) in zip(asked, search.best):
        all_scores = v @ v[q]
        best = sorted((-s, i) for i, s in enumerate(all_scores.tolist()) if i != q)[:5]
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == best


def test_feasible_holds():
    r = np.random.default_rng(9)
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in r.normal(size=(2, 4000, 4)))
    for p, q in zip(a, b):
        low, high = products.feasible(float(p @ q), q[0])
        assert low <= p[0] <= high


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = QUERIES["op13_top_products"][0](spark, folder).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == slow(rows, 5, 50)
