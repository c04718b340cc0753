import hashlib
import random
import re
from collections import defaultdict

import pytest

from convolens.llm import exact

SCHEMA = "doc_id long, text string, sha string"


def expected(rows):
    groups = defaultdict(list)
    for number, (doc, text, *_) in enumerate(rows):
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        groups[key].append((doc is None, doc or 0, number))
    out = []
    for key, members in groups.items():
        members.sort()
        for place, (none, doc, _) in enumerate(members):
            first = None if members[0][0] else members[0][1]
            out.append((None if none else doc, first, len(members), place == 0, key))
    return out


def case(kind):
    r = random.Random(4)
    if kind == "empty":
        return []
    if kind == "odd":
        return [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "\t\n", None), (5, "a b", "x"), (5, "a b", "x"),
                (5, "a  b", "x"), (None, "a b", "x"), (None, None, "x"), (None, "z", "x"), (6, "é" * 300_000, "x"),
                (7, "é" * 300_000, "x"), (-3, "a b", "x")]
    return [(i, r.choice(["hot text", f"text {r.randrange(60)}", f"own {i}", f"own  {i}"]), "s") for i in range(900)]


@pytest.mark.parametrize("kind", ["empty", "odd", "mixed"])
@pytest.mark.parametrize("slots", [1 << 16, 1 << 26])
def test_groups_and_dropping(spark, kind, slots):
    rows = case(kind)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in exact.duplicate_groups(docs, max_slots=slots).collect()]
    order = lambda r: [(x is None, x if x is not None else 0) for x in r]
    assert sorted(got, key=order) == sorted(expected(rows), key=order)
    kept = exact.drop_duplicates(docs, max_slots=slots)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(
        (d is None, d or 0) for d, _, _, k, _ in expected(rows) if k)


def test_filter_clears_single_rows(spark):
    docs = spark.createDataFrame([(i,) for i in range(5000)] + [(7,), (8,)], "h long").selectExpr("xxhash64(h) h")
    maybe = exact.repeated_filter(docs, "h", 5002)
    found = docs.where(maybe("h")).count()
    assert 4 <= found < 500
