"""Linking, topics, phrases and the parsing of answers."""

import random
import re
import sys
from collections import Counter

import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from convolens.functions import fixed, prompts, sections
from convolens.operators import followups, linking, topics
from convolens.plans.jobs import run_followups

QA = [
    ("Why did my parcel arrive damaged after transit?",
     "Parcels that pass two depots are damaged more often. A damaged parcel is replaced without cost."),
    ("When will a damaged parcel be replaced?",
     "Replacement parcels leave the depot within two days of the report."),
    ("Where can I change the delivery address?",
     "Open the order page and change the address before dispatch."),
]
CLUSTERS = [
    (0, "parcel_damage", ["parcel", "damaged", "depot"], 12, "parcels that arrive damaged"),
    (1, "address_change", ["address", "delivery", "change"], 6, "change of a delivery address"),
]


@pytest.fixture
def qa(spark):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(QA)], "qa_pos long, query string, response string")


@pytest.fixture
def clusters(spark):
    return spark.createDataFrame(CLUSTERS, "cluster_id int, action_label string, key_phrases array<string>, size int, summary string")


@pytest.mark.parametrize("inline", [1024, 0])
def test_link(spark, qa, clusters, inline):
    got = linking.link_qas(clusters, qa, inline).select("cluster_id", "qa_pos").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 1), (1, 2)]


def test_both_ways_of_linking_equal_the_rule(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(1, 6)))
    clusters = [(c, rng.choice(["", None, word().upper()]), [rng.choice(["", " " + word()]) for _ in range(3)]) for c in range(12)]
    qa = [(i, " ".join(word() for _ in range(3)).title(), rng.choice([None, word() + word()])) for i in range(60)]
    expected = set()
    for c, label, phrases in clusters:
        label = (label or "").lower().strip()
        for i, q, r in qa:
            q, r = q.lower(), (r or "").lower()
            if (label and (label in q or label in r)) or any(p.strip() and p.strip() in q for p in phrases):
                expected.add((c, i))
    cdf = spark.createDataFrame(clusters, "cluster_id int, action_label string, key_phrases array<string>")
    qdf = spark.createDataFrame(qa, "qa_pos int, query string, response string")
    for inline in (1024, 0):
        got = [tuple(r) for r in linking.match_pairs(cdf, qdf, inline).select("cluster_id", "qa_pos").collect()]
        assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("inline", [1024, 0])
def test_rows_that_share_a_position_are_tested_one_by_one(spark, inline):
    clusters = spark.createDataFrame([(0, "alpha", ["beta"])], "cluster_id int, action_label string, key_phrases array<string>")
    qa = spark.createDataFrame([(1, "has alpha beta", "x"), (1, "none", "y"), (2, "none", "alphabet")], "qa_pos int, query string, response string")
    got = linking.match_pairs(clusters, qa, inline).select("cluster_id", "qa_pos", "query").collect()
    assert sorted(map(tuple, got)) == [(0, 1, "has alpha beta"), (0, 2, "none")]


def test_dedupe_keeps_first_position_and_last_values(spark):
    rows = [(0, 0, "q", "r1"), (0, 1, "other", "x"), (0, 2, "q", "r2"), (1, 2, "q", "r2")]
    df = spark.createDataFrame(rows, "cluster_id int, qa_pos long, query string, response string")
    got = sorted(tuple(r) for r in linking.dedupe_queries(df).collect())
    assert got == [(0, 0, "q", "r2"), (0, 1, "other", "x"), (1, 2, "q", "r2")]


def test_topics_golden(spark, qa):
    got = [(r.topic, round(r.score, 6)) for r in topics.topics(qa).orderBy("rank").collect()]
    assert got == [("damaged", 1.6), ("parcel", 1.2), ("change", 1.0), ("address", 1.0), ("parcels", 0.8),
                   ("arrive", 0.6), ("after", 0.6), ("transit", 0.6)]


def test_topics_with_action(spark, qa, clusters):
    grouped = qa.where("qa_pos < 2").withColumn("cluster_id", F.lit(0))
    got = topics.topics(grouped, ["cluster_id"], clusters.where("cluster_id = 0")).orderBy("rank").collect()
    assert [(r.topic, round(r.score, 6)) for r in got] == [
        ("parcel_damage", 2.0), ("damaged", 1.6), ("parcel", 1.2), ("parcels", 0.8),
        ("arrive", 0.6), ("after", 0.6), ("transit", 0.6), ("will", 0.6)]


def test_phrases_golden(spark, qa):
    got = [(r.phrase, r.n) for r in topics.phrases(qa).orderBy("rank").collect()]
    assert got == [("damaged parcel", 2), ("parcel replaced", 2), ("damaged parcel replaced", 2), ("change the", 2), ("why did", 1)]


def test_phrases_equal_a_plain_count(spark, table):
    rows = table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qa_pos"),
                                         F.col("text").alias("query"), F.reverse("text").alias("response"))
    counts = Counter()
    for r in sorted(rows.collect()):
        w = re.findall(r"\b[a-z]{3,}\b", r.query.lower() + " " + r.response[:200].lower())
        counts.update(" ".join(p) for p in zip(w, w[1:]))
        counts.update(" ".join(p) for p in zip(w, w[1:], w[2:]))
    got = [(r.phrase, r.n) for r in topics.phrases(rows).orderBy("rank").collect()]
    assert got == counts.most_common(5)


def parse(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


def test_concepts(spark):
    answer = "- early one\nROOT_CAUSES:\n- late job.\n- Impact on SLA\n- x y z\n-  ab\n• dots;:,\nplain\nScenario list\n- p1 q"
    assert parse(spark, answer, sections.concept_map) == {
        "causal": ["late job"], "impact": ["x y z", "dots"], "pattern": ["p1 q"]}
    assert parse(spark, None, sections.concept_map) == {"causal": [], "impact": [], "pattern": []}


def test_questions(spark):
    answer = "QUESTION_1:\n[x] Why is a late?\n\nQUESTION_2:\n\nQUESTION_3:\nWhen?"
    assert len(parse(spark, answer, sections.question_sections)) == 2
    got = parse(spark, answer, sections.followups)
    assert [(f.question, f.category, f.sequence) for f in got] == [("Why is a late?", "causal", 1)]
    long = "QUESTION_1:\nno mark here\n" + "w " * 76 + "?\nQUESTION_7: Is it fine now?\nQUESTION_3: [a] [b] Does it hold?"
    got = parse(spark, long, sections.followups)
    assert [(f.question, f.category, f.sequence) for f in got] == [
        ("Is it fine now?", "impact", 2), ("[b] Does it hold?", "pattern", 3)]
    assert parse(spark, None, sections.followups) == []


def test_qa_contexts(spark):
    pairs = [("q" * 70, "a" * 160), ("q2", "b" * 101), ("q3", None), ("q4", "d")]
    df = spark.createDataFrame([(pairs,), ([],)], "v array<struct<query:string,response:string>>")
    row = df.select(*[f(F.col("v")) for f in (prompts.qa_for_concepts, prompts.qa_for_fusion, prompts.qa_for_followups)]).collect()
    assert row[0][0] == f"Q1: {'q' * 60}\nA1: {'a' * 120}...\n\nQ2: q2\nA2: {'b' * 101}...\n\nQ3: q3\nA3: ...\n\n"
    assert row[0][1] == f"Q1: {'q' * 70}\nA1: {'a' * 150}...\n\nQ2: q2\nA2: {'b' * 101}\n\nQ3: q3\nA3: \n\n"
    assert row[0][2] == f"Q1: {'q' * 70}\nA1: {'a' * 100}...\n\nQ2: q2\nA2: {'b' * 100}...\n\n"
    assert tuple(row[1]) == ("No QA data available", "No QA data available", "No additional context")


def fake_client():
    def client(prompt, system_prompt=None, max_tokens=None, temperature=None):
        assert max_tokens == 400
        if "QUESTION_1:" in prompt:
            assert "a → b" in prompt
            return "QUESTION_1:\nWhy does the job run late?\nQUESTION_2:\n[n] How many calls follow?"
        if "ROOT_CAUSES:" in prompt:
            return "ROOT_CAUSES:\n- late batch job\nIMPACTS:\n- more calls"
        assert "Root causes: late batch job" in prompt and "Impacts: more calls" in prompt
        return "CAUSAL_CHAIN:\n- a → b"

    return client


def test_followup_job(spark, qa, clusters, tmp_path):
    out = str(tmp_path / "followups")
    register_pickle_by_value(sys.modules[__name__])
    got = run_followups(clusters, qa, fake_client, out).orderBy("cluster_id").collect()
    assert [len(r.followups) for r in got] == [2, 2]
    assert got[0].topics[0] == "parcel_damage" and len(got[0].qas) == 2
    rows = spark.read.option("header", True).csv(out).orderBy("cluster_id", "question_number").collect()
    assert [tuple(r) for r in rows][:2] == [
        ("0", "parcel_damage", "1", "Why does the job run late?", "causal", "parcel_damage, damaged, parcel"),
        ("0", "parcel_damage", "2", "How many calls follow?", "impact", "parcel_damage, damaged, parcel")]


def test_followup_job_pays_once(spark, qa, clusters, tmp_path):
    register_pickle_by_value(sys.modules[__name__])
    log = str(tmp_path / "answers")
    expected = sorted(map(str, run_followups(clusters, qa, fake_client).collect()))
    for _ in range(2):
        assert sorted(map(str, run_followups(clusters, qa, fake_client, answer_log=log).collect())) == expected
        assert spark.read.parquet(log).count() == 6


def test_followup_job_without_client(spark, qa, clusters):
    got = run_followups(clusters, qa).collect()
    assert all(r.followups == [] and r.fused is None for r in got)


def test_bare_string_followups(spark):
    df = spark.createDataFrame([(1, "a", ["t1", "t2", "t3", "t4"], ["q?"])],
                               "cluster_id int, action_label string, topics array<string>, followups array<string>")
    assert tuple(followups.followup_rows(df).first()) == (1, "a", 1, "q?", fixed.OTHER_CATEGORY, "t1, t2, t3")
