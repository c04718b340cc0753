"""Golden values of tokens, turns, events and rules."""

import re

import pytest
from pyspark.sql import functions as F

from convolens.functions import text, turns
from convolens.functions.events import event_of_domain, sanitize_event
from convolens.functions.rules import question_form, violations


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v"))).first()[0]


def test_ascii_words_equal_python_word_borders(spark, table):
    rows = table("conversations").select("text", text.ascii_words(F.col("text"), 4).alias("w")).collect()
    assert rows and all(r.w == re.findall(r"\b[a-z]{4,}\b", r.text.lower()) for r in rows)
    odd = "don't e-mail x_abcd abcd1 été_abcd naïve ABCDE abcd"
    assert one(spark, odd, lambda c: text.ascii_words(c, 4)) == re.findall(r"\b[a-z]{4,}\b", odd.lower())


def test_strip_and_words_follow_unicode_space(spark):
    value = "　  a b c\n\x1f"
    assert one(spark, value, text.strip) == value.strip()
    assert one(spark, value, text.words) == value.split()
    assert one(spark, value, text.word_count) == 3


def test_ngrams(spark):
    grams = lambda n: one(spark, ["a", "b", "c"], lambda c: text.ngrams(c, n), "array<string>")
    assert grams(2) == ["a b", "b c"]
    assert grams(3) == ["a b c"]
    assert grams(4) == []


@pytest.mark.parametrize("query, expected", [
    ("Tell me why? The fee (late) is on it", ["tell", "why", "late"]),
    ("Why did it go?", []),
])
def test_keywords(spark, query, expected):
    assert one(spark, query, text.keywords) == expected


def test_plain_text_split(spark):
    raw = "  intro\nmore\n\nAgent: hi\n  there \nCustomer: yo\nagent: no"
    expected = ["intro more", "Agent: hi there", "Customer: yo agent: no"]
    assert one(spark, raw, turns.split_plain_text) == expected
    assert one(spark, " \n \n", turns.split_plain_text) == []
    rows = spark.createDataFrame([(raw,), (" ",)], "v string").select(turns.plain_text_episode(F.col("v")).alias("e"))
    first, blank = [r.e for r in rows.collect()]
    assert first.text_with_turns.split("\n")[1] == "Turn 2: Agent: hi there" and first.turn_count == 3
    assert [(t.number, t.speaker, t.text) for t in first.turns] == [
        (1, None, "intro more"), (2, "Agent", "hi there"), (3, "Customer", "yo agent: no")]
    assert (blank.text_with_turns, blank.text, blank.turn_count) == ("Turn 1: Unknown:  ", " ", 1)
    assert [tuple(t) for t in blank.turns] == [(1, "Unknown", " ")]


def test_parse_turns(spark):
    raw = ("Turn 1: Agent: hello: there\n  Turn 2:Customer: ok\nTurn x: A: b\nTurn 3: no\nnoise\n"
           "Turn 4: System Agent : \nTurn 7: : late")
    got = [(t.number, t.speaker, t.text) for t in one(spark, raw, turns.parse_turns)]
    assert got == [(1, "Agent", "hello: there"), (2, "Customer", "ok"), (4, "System Agent", ""), (7, "", "late")]


def test_speakers(spark):
    rows = spark.createDataFrame([("Customer",), ("CLIENT",), ("Agent",), (None,)], "v string")
    assert [r[0] for r in rows.select(turns.user_or_system(F.col("v"))).collect()] == ["user", "user", "system", "system"]


@pytest.mark.parametrize("domain, event", [
    ("Billing Support", "refund"), ("Retention Desk", "churn"), ("GDPR Requests", "compliance"),
    ("Complaint Handling", "escalation"), ("Hotel", "general"), ("Pricing complaint", "escalation"),
    (None, "general"), ("", "general"),
])
def test_events(spark, domain, event):
    assert one(spark, domain, event_of_domain) == event


def test_event_overrides(spark):
    overrides = {"Hotel": "Refund", "Billing": "odd"}
    assert one(spark, " hotel ", lambda c: event_of_domain(c, overrides)) == "refund"
    assert one(spark, "BILLING", lambda c: event_of_domain(c, overrides)) == "general"
    assert one(spark, "billing desk", lambda c: event_of_domain(c, overrides)) == "refund"
    assert one(spark, " Churn ", sanitize_event) == "churn"


@pytest.mark.parametrize("query, ok", [
    ("However it went", True), ("What is the cost?", False), ("What led to it?", False),
    ("what leads to it", True), ("Who did it", False), ("HOW so", True),
])
def test_question_form(spark, query, ok):
    assert one(spark, query, question_form) is ok


@pytest.mark.parametrize("row, broken", [
    (("Why did it break?", "refund denial", "churn", 3), []),
    (("", "Customer", "", 9), ["empty", "trigger", "outcome", "complexity"]),
    (("Why " + "w " * 50, "x", "RESULT", 2), ["too_long", "outcome"]),
    (("Why ask what date it was, who said so", "x", "y", 5), ["trivial"]),
    (("Why, and who said so", "x", "y", 5), ["factual"]),
    (("how what was it they mention", "x", "y", 5), ["factual"]),
    ((None, None, None, None), ["empty", "trigger", "outcome", "complexity"]),
])
def test_violations(spark, row, broken):
    df = spark.createDataFrame([row], "q string, t string, o string, n int")
    assert df.select(violations(*[F.col(c) for c in "qton"])).first()[0] == broken


def test_literals_become_python_objects_some_rows_at_a_time(monkeypatch):
    import pyarrow as pa

    from convolens.functions import literals
    sizes, real = [], literals._piece_as_json
    monkeypatch.setattr(literals, "_piece_as_json", lambda text: sizes.append(len(text)) or real(text))
    cells = ["[1, None]", None, "{'a': 1}", "[1,", "['é']"] * 100
    got = literals.python_list_as_json.func(pa.array(cells)).to_pylist()
    assert [r["json"] for r in got] == ["[1, null]", None, None, None, '["\\u00e9"]'] * 100
    assert sum(sizes) == 500 and max(sizes) <= literals.PIECE_ROWS
    assert len(literals.python_list_as_json.func(pa.array([], pa.string()))) == 0
