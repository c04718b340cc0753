import random
import re

import numpy as np
import pytest
import xxhash

from convolens.llm import graph, simhash
from convolens.llm.queries import QUERIES


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits=4):
    """Smallest index reachable from each."""
    values = sorted(set(prints))
    array = np.array(values, np.uint64)
    name = {}
    for value in values:
        if value in name:
            continue
        reached, todo = {value}, [value]
        while todo:
            for other in array[np.bitwise_count(array ^ np.uint64(todo.pop())) <= bits].tolist():
                if other not in reached:
                    reached.add(other)
                    todo.append(other)
        first = min(i for i, p in enumerate(prints) if p in reached)
        name.update(dict.fromkeys(reached, first))
    return [name[p] for p in prints]


def test_fingerprint_by_definition(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    r = random.Random(1)
    texts = [None, "", " \t", "One", "one two three", "A b C d É", "x\x1cy z", "a\x0bb\x0cc\rd e  f"]
    texts += [" ".join(r.choice(["the", "Of", "ÄH", f"w{r.randrange(9)}"]) for _ in range(n)) for n in (4, 5, 9, 80)]
    for text in texts:
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("max_file", [1 << 16, 5])
def test_links_lose_no_component(spark, max_file):
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(150)]
    for _ in range(350):
        value = r.choice(prints)
        for bit in r.sample(range(64), r.choice([1, 2, 4, 4, 5])):
            value ^= 1 << bit
        prints.append(value)
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in sorted(set(prints))], "fp long").repartition(3)
    roots = {r.node: r.root for r in graph.components(simhash.links(nodes, max_file=max_file)).collect()}
    named = [roots.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    expected = slow_components(prints)
    assert len(set(named)) == len(set(expected)) == len(set(zip(named, expected)))


def test_components_of_odd_graphs(spark):
    edges = [(5, 5), (1, 2), (2, 1), (None, 3), (9, 8), (8, 7), (7, 6)] + [(100 + i, 101 + i) for i in range(60)]
    edges += [(1000, 2000 + i) for i in range(50)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[2] == 1 and got[9] == 6 and got[160] == 100 and got[2049] == 1000 and 5 not in got and 3 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = [(4, None, "a"), (2, "", "b"), (None, " ", "c"), (7, "some words here and there", "d"),
            (7, "some words here and there", "d"), (None, "only this one", "e"), (9, "x " * 400_000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == {(4, 2), (2, 2), (None, 2), (7, 7), (None, None), (9, 9)}
    left = simhash.keep_one_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 2, 7, 7, 9]
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    prints = [slow_fingerprint(d.text) for d in docs]
    expected = {(d.doc_id, f"{p:016x}", docs[c].doc_id) for d, p, c in zip(docs, prints, slow_components(prints))}
    assert {tuple(r) for r in QUERIES["op3_simhash_near_dedup"][0](spark, folder).collect()} == expected
