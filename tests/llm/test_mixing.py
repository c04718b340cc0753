import random
import re
from collections import Counter, defaultdict

import pytest

from convolens.llm import mixing
from convolens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, of_id string"


def slow_targets(sizes):
    """sizes: source -> words."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return share | {s: 2 * sizes[s] for s in capped}
        capped |= above


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def half_longest(docs):
    return lambda source: max(words(d[1]) for d in docs if d[2] == source) / 2 + 1


def check(docs, got, tolerance):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    by_id = {d[0]: d for d in docs}
    for _, text, source, *_ in docs:
        sizes[source] += words(text)
    expected = slow_targets(sizes)
    assert len(got) == len(docs)
    for r in got:
        source = by_id[r.doc_id][2]
        assert r.size == words(by_id[r.doc_id][1]) and r.source_size == sizes[source]
        assert r.target == pytest.approx(expected[source], rel=1e-9)
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        taken[source] += r.taken
        targets[source] = r.target
    for source, target in targets.items():
        assert abs(taken[source] - target) <= tolerance(source), source


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_targets_and_copies(spark, bucket_rows):
    r = random.Random(3)
    docs = [(i, " ".join(["w"] * int(r.paretovariate(1.1) * 5 % 800)), r.choice(["hot"] * 4 + ["a", "b", "É", None]), "x")
            for i in range(900)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = mixing.mixture(frame, bucket_rows=bucket_rows).collect()
    check(docs, got, half_longest(docs))
    again = mixing.mixture(frame.repartition(7), bucket_rows=bucket_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = mixing.mix(frame, bucket_rows=bucket_rows)
    assert mixed.columns == frame.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_exchange_keeps_words_and_expectation():
    r = random.Random(5)
    for _ in range(300):
        sa, sb, pa, pb = r.uniform(1, 900), r.uniform(1, 900), r.uniform(.01, .99), r.uniform(.01, .99)
        mean = [0.0, 0.0]
        steps = 2000
        for k in range(steps):
            a, b = mixing.exchange(sa, pa, sb, pb, (k + .5) / steps)
            assert sa * a + sb * b == pytest.approx(sa * pa + sb * pb)
            assert a in (0.0, 1.0) or b in (0.0, 1.0)
            mean[0] += a / steps
            mean[1] += b / steps
        assert mean == pytest.approx([pa, pb], abs=2e-3)


def test_odd_rows(spark):
    docs = [(1, None, "a", "x"), (2, "", None, "x"), (3, "w w w", None, None), (3, "w w w", None, None),
            (None, "w " * 50, "a", "x"), (None, "w " * 50, "a", "x"), (4, "w " * 300_000, "b", "x"), (5, " \t", "c", "x")]
    frame = spark.createDataFrame(docs, SCHEMA)
    got = mixing.mixture(frame).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.copies <= 2 and r.taken == r.size * r.copies for r in got)
    assert len({(r.taken) for r in got if r.doc_id == 3}) == 1
    assert mixing.mix(frame).count() == sum(r.copies for r in got)
    assert mixing.mixture(frame.limit(0)).count() == 0 and mixing.mix(frame.limit(0)).count() == 0
    # One source, and texts without words only.
    assert mixing.mixture(frame.where("doc_id in (1, 5)")).selectExpr("sum(taken)").first()[0] == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(docs, QUERIES["op2_mixing"][0](spark, folder).collect(), half_longest(docs))
