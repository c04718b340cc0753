import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from convolens.llm import divergence
from convolens.llm.text import pieces

SCHEMA = "doc_id long, text string, lang string, source string, p int, term string, n_chars long"


def slow(rows, min_docs=10, top=10):
    docs = [(l or "", s or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t)
                                for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, l, s in rows]
    out = []
    for lang in {l for l, _, _ in docs}:
        seen = Counter(t for l, _, ts in docs if l == lang for t in set(ts))
        kept = {t for t, n in seen.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for l, s, ts in docs:
            if l == lang:
                counts[s].update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 10 ** 9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        for s, c in counts.items():
            pair = [(-sum((p(c, t) - p(d, t)) ** 2 // (p(c, t) + p(d, t)) for t in kept), o.encode(), o)
                    for o, d in counts.items() if o != s]
            term = [(-((p(c, t) - p(whole, t)) ** 2 // (p(c, t) + p(whole, t))), t.encode(), t)
                    for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, n + 1) for n, (v, _, item) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 1, "x", 5) for i, (t, l, s) in enumerate(rows)], SCHEMA).repartition(3)


def got(df, **options):
    return sorted(tuple(r) for r in divergence.divergence(df, **options).collect())


def documents():
    words = ["Alpha", "beta", "GAMMA", "Ärger", "ärger", "naïve", "日本", "d1e", "x"]
    rows = [(" ".join(words[(i * j) % 9] for j in range(1 + i % 7)) + f", w{i % 3}x", "en", f"s{i % 4}") for i in range(90)]
    rows += [(None, "en", "empty"), ("", None, None), (None, None, "s"), ("alpha" * 20_000, "en", "long"), ("beta " * 70_000, "en", "long")]
    rows += [("tie one two three", None, f"s{i % 2}") for i in range(24)] + [("few words", "fr", "a"), ("few", "fr", "b"), ("few", "fr", "b")]
    return rows


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_equals_brute_force(spark, bits):
    rows = documents()
    expected = slow(rows)
    assert {r[2] for r in expected} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in expected)
    assert got(frame(spark, rows), bits=bits) == expected


def test_ranks_beyond_the_top_and_ties(spark):
    rows = [(" ".join(f"{c}{d}" for c in "bac" for d in "yxz" * (1 + i % 2)), "en", f"s{i % 2}") for i in range(40)]
    assert got(frame(spark, rows), top=2, min_docs=3) == slow(rows, 3, 2)


def test_empty_table(spark):
    assert got(frame(spark, documents()).limit(0)) == []


def test_large_counts_stay_exact(spark):
    n, total, v = 7_654_321_987_654, 9_876_543_210_987, 123_456_789
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(
        divergence.share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (n + 2) // (total + 2 * v)


def test_no_text_moves_before_the_end(spark):
    """Counting exchanges digests: no string but the group's names."""
    df = frame(spark, documents()).select("lang", "source", "text")
    counted = df.mapInArrow(divergence._counted(64, False), "lang string, source string, digest long, n long, docs long")
    assert [f.dataType.simpleString() for f in counted.schema if f.name not in ("lang", "source")] == ["bigint"] * 3


def test_batches_are_counted_piece_by_piece():
    import pyarrow as pa

    from convolens.llm import divergence, text
    texts = ["a b " * n for n in (1, 700_000, 2, 300_000, 300_000, 0)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 6, "source": ["x", "y"] * 3, "text": texts}).slice(1)
    runs = list(text.pieces(batch, 2))
    assert [p.num_rows for p in runs] == [1, 2, 2]
    assert pa.Table.from_batches(runs).equals(pa.Table.from_batches([batch]))
    out = list(divergence._counted(64, True)(iter([batch])))
    assert len(out) == 3
    sums = pa.Table.from_batches(out).group_by(["source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).to_pylist()
    assert sorted((r["source"], r["term"], r["n_sum"], r["docs_sum"]) for r in sums) == [
        (s, t, n, d) for s, n, d in (("x", 300_002, 2), ("y", 1_000_000, 2)) for t in "ab"]


def test_tasks_tell_each_term_once(monkeypatch):
    """Pieces of a task are summed up, and a term is told once, however many pieces hold it."""
    docs = [("en" if i % 2 else "de", f"s{i % 3}", f"Same words é{i % 2} in_all pieces x{i % 5}\x85y ") for i in range(400)]
    batch = pa.RecordBatch.from_pydict(dict(zip(("lang", "source", "text"), (pa.array(c) for c in zip(*docs)))))
    monkeypatch.setattr(divergence, "pieces", lambda b, column: pieces(b, column, 500))
    each = Counter((lang, source, term) for lang, source, found in docs for term in {t.lower() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", found)})
    for with_text in (False, True):
        got = pa.Table.from_batches(divergence._counted(64, with_text, 1 << 20)(iter([batch, batch])))
        assert len(got) == len(each) and sorted(got["docs"].to_pylist()) == sorted(2 * n for n in each.values())
    told = pa.Table.from_batches(divergence._texts(64)(iter([batch, batch])))
    assert sorted(zip(told["lang"].to_pylist(), told["term"].to_pylist())) == sorted({(lang, term) for lang, _, term in each})
    # With room for few rows the sums go out in parts, and nothing is lost.
    monkeypatch.setattr(divergence, "HELD_TERMS", 4)
    got = pa.Table.from_batches(divergence._counted(64, True, 8)(iter([batch, batch])))
    sums = Counter()
    for lang, source, term, n in zip(*(got[c].to_pylist() for c in ("lang", "source", "term", "docs"))):
        sums[lang, source, term] += n
    assert sums == Counter({k: 2 * n for k, n in each.items()})
    told = pa.Table.from_batches(divergence._texts(64)(iter([batch, batch])))
    assert set(zip(told["lang"].to_pylist(), told["term"].to_pylist())) == {(lang, term) for lang, _, term in each}
