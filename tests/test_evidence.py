"""Fuzzy containment against brute force, and grounding against a plain reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from convolens.functions import fuzzy
from convolens.functions.fuzzy import best_scores, partial_ratio
from convolens.functions.text import keywords
from convolens.operators import evidence


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(a, b):
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(one_way(a, b), one_way(b, a))
    return one_way(*sorted((a, b), key=len))


def one_way(a, b):
    windows = {b[max(0, i):i + len(a)] for i in range(1 - len(a), len(b))}
    return max(200 * lcs(a, w) / (len(a) + len(w)) for w in windows if w)


@pytest.mark.parametrize("a, b, score", [
    ("refund", "i will refund you", 100), ("refunds", "i will refund you", 85.7143),
    ("cancelled", "we can cancel it", 66.6667), ("charged", "surcharge", 92.3077), ("", "x", 0),
])
def test_partial_ratio_golden(spark, a, b, score):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(partial_ratio("a", "b")).first()[0]
    assert got == pytest.approx(score, abs=1e-4)


def test_best_scores_equal_brute_force():
    rng = random.Random(7)
    letters = "abcdé\U0001f600 "
    for _ in range(300):
        needles = ["".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(3)]
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(4)]
        expected = [max(brute(n, t) for n in needles) for t in texts]
        assert best_scores(needles, texts) == pytest.approx(expected)


def test_scores_from_a_floor_equal_brute_force(monkeypatch):
    rng = random.Random(11)
    words = ["refund", "refunds", "cancelled", "customer", "delay", "abab", "aa", "b", "charged", "", "x" * 64, "y" * 70]
    parts = ["abc", "refun", "surcharge ", "cancel", "é", "d", " the ", "delya", "customre", "x" * 60]
    rows = [(rng.sample(words, 3) + ["".join(rng.choices("abcdé", k=rng.randint(1, 9)))],
             ["".join(rng.choices(parts, k=rng.randint(0, 5))) for _ in range(3)]) for _ in range(150)] + [([], ["a"]), (["a"], [])]
    exact = [[max((brute(n, text) for n in needles), default=0.0) for text in texts] for needles, texts in rows]
    for floor, cells in ((60, 500_000), (85, 700), (92.5, 500_000), (100, 1)):
        monkeypatch.setattr(fuzzy, "_FLAT_WINDOWS", cells)
        for got, expected in zip(fuzzy.scores_from(rows, floor), exact, strict=True):
            for score, right in zip(got, expected, strict=True):
                assert score == pytest.approx(right) if right >= floor else score < floor


def test_few_windows_reach_the_floor():
    rng = random.Random(12)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(800))
    needles = ["shoulder", "aeration", "ratioed!", "in other"]
    jobs = [(needle, text, fuzzy._candidates(fuzzy._pairs(needle), len(text), fuzzy._where(text), 85)) for needle in needles]
    best, scored = fuzzy.window_scores(jobs, 85), sum(len(windows) for *_, windows in jobs)
    assert scored < 0.02 * len(needles) * len(text)
    every = [best_scores([needle], [text])[0] for needle in needles]
    assert [s if s >= 85 else 0 for s in best] == [s if s >= 85 else 0 for s in every]


def test_long_needles_equal_brute_force():
    rng = random.Random(3)
    for size in (62, 63, 64, 90):
        needle = "".join(rng.choices("abc", k=size))
        text = "".join(rng.choices("abc", k=200))
        assert best_scores([needle], [text])[0] == pytest.approx(brute(needle, text))


def reading(query_words, turns, threshold):
    """(agent turn, response turn, score) by the rules, over (number, speaker, text)."""
    best, top = None, 0
    for number, speaker, text in turns:
        if "agent" in speaker.lower():
            score = max((brute(w, text.lower()) for w in query_words), default=0)
            if score > top:
                best, top = number, score
    if best is None or top < threshold:
        return None, None, None
    reply = next((n for n, s, _ in turns if n > best and "customer" in s.lower()), None)
    return best, reply, top


def cases():
    rng = random.Random(11)
    vocabulary = ["refund", "billing", "cancel", "charged", "portal", "delay", "agreed", "the", "why"]
    for case in range(40):
        numbers = list(range(1, rng.randint(1, 9)))
        if case % 4 == 0:
            rng.shuffle(numbers)
        turns = [
            (n, rng.choice(["Agent", "Customer", "Lead agent", "System"]),
             " ".join(w[:rng.randint(3, 9)] for w in rng.choices(vocabulary, k=3)))
            for n in numbers
        ]
        query = " ".join(rng.choices(vocabulary, k=rng.randint(0, 3)))
        yield case, query, turns


@pytest.mark.parametrize("threshold", [85, 60, 100])
def test_ground_equals_plain_reading(spark, threshold):
    data = list(cases())
    rows = [(i, q, "\n".join(f"Turn {n}: {s}: {t}" for n, s, t in turns)) for i, q, turns in data]
    df = spark.createDataFrame(rows, "i int, query string, transcript string").withColumn("w", keywords(F.col("query")))
    for r in evidence.ground(df, threshold).collect():
        agent, reply, score = reading(r.w, data[r.i][2], threshold)
        assert (r.agent_turn, r.customer_response_turn) == (agent, reply)
        if agent is None:
            assert (r.evidence_quality, r.grounding_confidence) == ("weak", 0.0)
        else:
            assert r.score == pytest.approx(score)
            assert r.grounding_confidence == pytest.approx((score + (100 if reply else 0)) / 200)
            assert r.evidence_quality == ("strong" if score >= 95 else "moderate" if score >= 80 else "weak")


@pytest.mark.parametrize("threshold", [85, 100])
def test_ground_turns_equals_plain_reading(spark, threshold):
    data = [(i, q, sorted(turns)) for i, q, turns in cases()]
    queries = spark.createDataFrame([(i, i, q) for i, q, _ in data], "query_id int, conv_id int, query string")
    queries = queries.withColumn("w", keywords(F.col("query")))
    words = {r.query_id: r.w for r in queries.collect()}
    turns = spark.createDataFrame(
        [(i, *t) for i, _, ts in data for t in ts], "conv_id int, number int, speaker string, text string"
    )
    got = evidence.ground_turns(queries, turns, threshold).collect()
    assert len(got) == len(data)
    for r in got:
        agent, reply, score = reading(words[r.query_id], data[r.query_id][2], threshold)
        assert (r.agent_turn, r.customer_response_turn) == (agent, reply)
        assert r.score == (pytest.approx(score) if agent else None)


def test_next_customer_turn_crosses_blocks(spark):
    speakers = ["Customer" if n % 7 == 0 else "Agent" for n in range(50)]
    turns = spark.createDataFrame([(1, n, s) for n, s in enumerate(speakers)], "conv_id int, number int, speaker string")
    for r in evidence.next_customer_turns(turns, block=3).collect():
        assert r.customer_response_turn == next((n for n in range(r.number + 1, 50) if n % 7 == 0), None)


def test_location(spark):
    df = spark.createDataFrame([(None, None), (8, None), (8, 9)], "a int, b int")
    assert [r[0] for r in df.select(evidence.location(F.col("a"), F.col("b"))).collect()] == ["N/A", "Turn 8", "Turns 8-9"]
