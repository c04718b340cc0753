import random

import numpy as np

from convolens.llm import licenses
from convolens.llm.queries import QUERIES

LINES = ["Apache-2.0", "CC-BY-NC-4.0", "GPL-3.0", "MIT", "All-rights-reserved"]


def slow_scan(scanner, text):
    """Every template against the whole text, on all diagonals: the best match of each."""
    ids = np.array([scanner.number.get(w, 0) for w in licenses.words_of(text.encode())])
    out = {}
    for name, template in zip(scanner.names, scanner.templates):
        matched, *_ = licenses.align(template, ids, -len(template), len(ids))
        if matched >= scanner.min_coverage * len(template):
            out[name] = matched
    return out


def test_winnowing_guarantee():
    r = np.random.default_rng(1)
    for _ in range(200):
        shared = r.integers(1, 50, 5)
        a = np.r_[r.integers(1, 50, r.integers(0, 20)), shared, r.integers(1, 50, r.integers(0, 20))]
        b = np.r_[r.integers(1, 50, r.integers(0, 20)), shared, r.integers(1, 50, r.integers(0, 20))]
        x, y = licenses.Scanner.hashes(a), licenses.Scanner.hashes(b)
        assert set(x[licenses.winnow(x)].tolist()) & set(y[licenses.winnow(y)].tolist())


def test_matches_by_brute_force():
    r = random.Random(2)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for _ in range(60):
        name = r.choice(scanner.names)
        words = licenses.TEMPLATES[name].split()
        for _ in range(r.randrange(0, 1 + len(words) // 12)):
            at = r.randrange(len(words))
            words[at:at + 1] = r.choice([[], ["other"], [words[at], "added"]])
        noise = lambda: " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(40)))
        text = f"{noise()} {' '.join(words)} {noise()}"
        found = {m[0]: m[2] for m in scanner.scan(text.encode())}
        slow = slow_scan(scanner, text)
        # Overlapping templates of fewer words give way.
        best = max(slow.values())
        assert found and max(found.values()) == best and all(slow[n] >= m for n, m in found.items())


def slow_all(scanner, name, text):
    """All matches of one template, the best first, then those left and right of it."""
    template = scanner.templates[scanner.names.index(name)]
    ids = np.array([scanner.number.get(w, 0) for w in licenses.words_of(text.encode())])
    out, parts = [], [(0, len(ids))]
    while parts:
        first, last = parts.pop()
        matched, start, end = licenses.align(template, ids[first:last], -len(template), last - first)
        if matched >= scanner.min_coverage * len(template):
            out.append((matched, first + start, first + end))
            parts += [(first, first + start), (first + end, last)]
    return sorted(out)


def test_back_to_back_repeats_by_brute_force():
    r = random.Random(4)
    for name in ("MIT", "CC-BY-4.0-long", "ISC"):
        scanner = licenses.Scanner({name: licenses.TEMPLATES[name]})
        for gap in (0, 1, 3, 7):
            text = " ".join(" ".join(f"pkg{r.randrange(99)}" for _ in range(gap)) + " " + licenses.TEMPLATES[name] for _ in range(30))
            spans = [m.span() for m in licenses.WORD.finditer(text.lower().encode())]
            slow = sorted((m, spans[a][0], spans[b - 1][1]) for m, a, b in slow_all(scanner, name, text))
            assert len(slow) == 30 and sorted((m[2], m[4], m[5]) for m in scanner.scan(text.encode())) == slow
    scanner = licenses.Scanner(licenses.TEMPLATES)
    long = "pkgA Released under the MIT License. " * 5_000
    assert [m[0] for m in scanner.scan(long.encode())] == ["MIT"] * 5_000


def test_families_and_templates_as_a_table(spark):
    families = ["AGPL-3.0-header", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "EPL-2.0", "GPL-3.0-header", "LGPL-2.1-header", "Unlicense"]
    every = {**licenses.TEMPLATES, **licenses.FAMILIES}
    frame = spark.createDataFrame([(i, f"x {every[n]} y") for i, n in enumerate(families)], "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.coverage) for r in licenses.scan(frame, every).collect()) == [
        (i, n, 1.0) for i, n in enumerate(families)]
    # A single shingle is found beside any words, also of other templates.
    table = spark.createDataFrame([*every.items(), *licenses.NOTICES.items()], "name string, text string")
    docs = [(i, f"{a} All Rights Reserved. {b}") for i, (a, b) in enumerate(
        (a, b) for a in ("", "x", "the software is") for b in ("", "y", "permission is hereby", "Released under the MIT License."))]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert sorted(r.doc_id for r in got if r.license == "All-rights-reserved") == list(range(len(docs)))


def test_odd_rows(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, "no license here"), (4, f"é {mit} x"), (4, f"é {mit} x"), (None, mit.upper()),
            (5, ("word " * 50_000) + mit + (" word" * 50_000) + " " + mit), (6, "released under the")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = licenses.scan(frame).collect()
    assert sorted((r.doc_id or 0, r.license, r.coverage) for r in got) == [
        (0, "MIT", 1.0), (4, "MIT", 1.0), (4, "MIT", 1.0), (5, "MIT", 1.0), (5, "MIT", 1.0)]
    for r in got:
        text = dict(rows)[r.doc_id]
        assert text[r.start_char:r.end_char].lower() == mit[:-1].lower()
    assert licenses.scan(frame.limit(0)).count() == 0


def test_query_finds_all_lines(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    expected = {(d.doc_id, n) for d in docs for n in LINES if licenses.EVERY[n] in (d.text or "")}
    got = QUERIES["op7_license_scan"][0](spark, folder).collect()
    assert expected and {(r.doc_id, r.license) for r in got if r.coverage == 1} == expected
