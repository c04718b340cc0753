"""Profiles, clustering, seeds, judging and the jobs."""

import json
import os
import random
import sys

import numpy as np
import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from convolens.functions import fixed
from convolens.operators import completion, embedding, generation, judging, profile
from convolens.plans import jobs

register_pickle_by_value(sys.modules[__name__])


def test_key_phrases_golden(spark):
    rows = [(0, 0, "refund refund delay"), (0, 1, "refund billing"), (0, 2, "billing delay portal"), (1, 3, "the and of")]
    df = spark.createDataFrame(rows, "cluster int, id int, text string")
    got = profile.key_phrases(df).orderBy("cluster", "rank").collect()
    assert [(r.cluster, r.term) for r in got] == [(0, "refund"), (0, "billing"), (0, "delay"), (0, "portal")]
    assert [r.score for r in got] == pytest.approx([1.601534, 1.224963, 0.965070, 0.680919], abs=1e-6)


@pytest.fixture
def utterances(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 2), i, f"text {'good' if i % 2 else 'bad'} {i}", "user" if i % 3 else "system",
             [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    return spark.createDataFrame(rows, "cluster int, id int, text string, speaker string, embedding array<float>")


def test_centroids_and_exemplars(spark, utterances):
    rows = utterances.collect()
    centers = {r.cluster: r.centroid for r in profile.centroids(utterances).collect()}
    best = {}
    for c in (0, 1):
        mine = [r for r in rows if r.cluster == c]
        mean = np.mean([r.embedding for r in mine], axis=0)
        assert centers[c] == pytest.approx(mean.tolist())
        cosine = lambda v: np.dot(v, mean) / np.linalg.norm(v) / np.linalg.norm(mean)
        best[c] = [r.id for r in sorted(mine, key=lambda r: -cosine(r.embedding))[:5]]
    got = profile.exemplars(utterances).orderBy("cluster", "rank").collect()
    assert {c: [r.id for r in got if r.cluster == c] for c in (0, 1)} == best


def test_nearest_label_ways_agree(spark, utterances):
    rng = random.Random(2)
    labels = {f"l{i}": [rng.uniform(-1, 1) for _ in range(4)] for i in range(7)}
    labels["l7"] = labels["l2"]
    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(labels.items())], "pos int, label string, vector array<double>")
    ways = [profile.nearest_label(utterances, labels), profile.nearest_label(utterances, table),
            profile.nearest_label(utterances, table, block=3)]
    got = [{r.id: r.action_label for r in w.collect()} for w in ways]
    assert got[0] == got[1] == got[2] and "l7" not in got[0].values()
    assert ways[2].columns == [*utterances.columns, "action_label", "label_similarity"]


def test_tone_and_profile(spark, utterances):
    lexicon = spark.createDataFrame([("good", 0.5), ("bad", -0.7)], "word string, polarity double")
    ontology = {name: [float(i == j) for j in range(4)] for i, name in enumerate("abcd")}
    rows = profile.profile_clusters(utterances, ontology, lexicon).orderBy("cluster_id").collect()
    assert [(r.cluster_id, r.tone, r.size, r.success_rate) for r in rows] == [(0, "negative", 20, None), (1, "positive", 20, None)]
    for r in rows:
        assert r.key_phrases[0] in ("text", "good", "bad") and len(r.exemplars) == 5
        assert sum(r.speaker_distribution.values()) == r["size"]
        assert r.summary == f"Action: {r.action_label}. Key themes: {', '.join(r.key_phrases)}. Example: '{r.exemplars[0]}'"


def test_success_rate(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (0, "z"), (1, "z")], "cluster int, conv_id string")
    outcomes = spark.createDataFrame([("a", True), ("b", False)], "conv_id string, success boolean")
    got = {r.cluster: r.success_rate for r in profile.success_rate(rows, outcomes).collect()}
    assert got == {0: pytest.approx(2 / 3), 1: None}


def test_cluster_invariants(spark, table):
    rows = table("embeddings").withColumnRenamed("vec_id", "id")
    got = embedding.cluster(rows, restarts=2).select("id", "cluster", "embedding").collect()
    sizes = np.bincount([r.cluster for r in got])
    assert len(got) == rows.count() and len(sizes) == 8 and list(sizes) == sorted(sizes, reverse=True)
    points = np.array([r.embedding for r in got])
    labels = np.array([r.cluster for r in got])
    centers = np.array([points[labels == c].mean(axis=0) for c in range(8)])
    nearest = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == labels).mean() > 0.97


@pytest.mark.parametrize("n, k", [(0, 1), (1, 1), (3, 3), (20, 8)])
def test_cluster_count(spark, n, k):
    assert embedding.cluster_count(spark.range(n)) == k


def encoder():
    return lambda texts: np.array([[len(t), 0.0] if t != "zero" else [0.0, 0.0] for t in texts], dtype="float32")


def test_embed_with_encoder(spark):
    df = spark.createDataFrame([("abc",), ("zero",)], "text string")
    assert sorted(r.embedding for r in embedding.embed(df, encoder).collect()) == [[1.0, 0.0], [3.0, 0.0]]


CLUSTERS = [(0, "refund_request", ["refund", "{action}"]), (1, "subscription_cancellation", [])]


def test_seeds_and_queries(spark):
    df = spark.createDataFrame(CLUSTERS, "cluster_id int, action_label string, key_phrases array<string>")
    seeds = [r.seed for r in generation.seeds(df).orderBy("cluster_id", "template_pos").collect()]
    assert seeds[0] == "Why do customers frequently refund_request when discussing refund?" and len(seeds) == 8
    assert seeds[5] == "How does subscription_cancellation impact the resolution of subscription_cancellation issues?"
    got = [r.query for r in generation.generate_queries(df).orderBy("rank").collect()]
    assert got == [seeds[2], seeds[3], seeds[6], seeds[7]]
    assert [r.query for r in generation.generate_queries(df, max_queries=1).collect()] == [seeds[2]]


def seed_client():
    def client(prompt, system_prompt=None):
        if "Compare" in prompt:
            raise RuntimeError("down")
        return " one line \n\nsame line\n" if "Why do" in prompt else None
    return client


def test_expansion_with_client(spark):
    df = spark.createDataFrame(CLUSTERS, "cluster_id int, action_label string, key_phrases array<string>")
    got = [r.query for r in generation.expand_seeds(generation.seeds(df), seed_client).orderBy("cluster_id", "template_pos", "line_pos").collect()]
    assert got[:2] == ["one line", "same line"] and len(got) == 10 and got[2].startswith("How does")
    kept = [r.query for r in generation.generate_queries(df, seed_client).orderBy("rank").collect()]
    assert len(kept) == 4 and "one line" not in kept


def test_length_band_keeps_all_when_none_fits(spark):
    df = spark.createDataFrame([("short",), ("also short",)], "query string")
    assert generation.keep_length_band(df).count() == 2
    assert generation.keep_length_band(df.where("query = 'x'")).count() == 0


@pytest.mark.parametrize("scores, aggregate, decision", [((4, 4, 3), 3.67, "ACCEPT"), ((4, 3, 3), 3.33, "REJECT"), ((1, 1, 1), 1.0, "REJECT")])
def test_decision(spark, scores, aggregate, decision):
    df = spark.createDataFrame([scores], "causal_depth int, clarity int, business_value int")
    row = judging.with_decision(df).first()
    assert (row.aggregate_score, row.decision) == (aggregate, decision)


def grading_client():
    answers = {
        "good": {"causal_depth": 5, "clarity": 4, "business_value": 2, "aggregate_score": 1.0, "decision": "REJECT", "reasoning": "r"},
        "range": {"causal_depth": 6, "clarity": 4, "business_value": 2, "aggregate_score": 1.0, "decision": "REJECT", "reasoning": "r"},
        "enum": {"causal_depth": 5, "clarity": 4, "business_value": 2, "aggregate_score": 1.0, "decision": "MAYBE", "reasoning": "r"},
    }

    def client(prompt, system_prompt=None):
        assert system_prompt
        return next((json.dumps(a) for word, a in answers.items() if f"Question: {word}" in prompt), "no json")
    return client


def test_judge(spark):
    df = spark.createDataFrame([(q, "refund", "c") for q in ("good", "range", "enum", "text")], "query string, event_type string, context string")
    got = {r.query: (r.causal_depth, r.aggregate_score, r.decision, r.reasoning) for r in judging.judge(df, grading_client).collect()}
    failed = (1, 1.0, "REJECT", fixed.FAILED_REASON)
    assert got == {"good": (5, 3.67, "ACCEPT", "r"), "range": failed, "enum": failed, "text": failed}
    assert {(r.aggregate_score, r.decision) for r in judging.judge(df).collect()} == {(3.67, "ACCEPT")}


def test_score_statistics(spark):
    df = spark.createDataFrame([("ACCEPT", 4, 4, 3, 3.67), ("REJECT", 1, 1, 1, 1.0)],
                               "decision string, causal_depth int, clarity int, business_value int, aggregate_score double")
    assert judging.acceptance_rate(df).first()[0] == 0.5
    assert tuple(judging.average_scores(df).first()) == pytest.approx((2.5, 2.5, 2.0, 2.335))
    assert judging.acceptance_rate(df.limit(0)).first()[0] == 0.0
    assert tuple(judging.average_scores(df.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)


def test_cost(spark):
    df = spark.createDataFrame([("gpt-4o", 1_000_000, 1_000_000), ("none", 5, 5)], "model string, input_tokens long, output_tokens long")
    assert {r.model: r.cost for r in completion.cost_by_model(df).collect()} == {"gpt-4o": 20.0, "none": 0.0}


def test_query_job(spark, tmp_path):
    rng = random.Random(4)
    words = ["refund", "billing", "cancel", "portal", "delay", "agent", "login", "password"]
    turns = lambda: [{"speaker": rng.choice(["Customer", "Agent"]), "text": " ".join(rng.choices(words, k=5))} for _ in range(4)]
    data = [{"transcript_id": str(i), "domain": "Hotel" if i % 2 else "Bank", "conversation": turns()} for i in range(10)]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(data))
    got = jobs.run_queries(spark, str(path), str(tmp_path / "q"), str(tmp_path / "m"), domain="hotel", max_transcripts=3, restarts=1)
    assert 0 < got.count() <= 8 * len(fixed.SEED_TEMPLATES)
    metrics = json.loads(next((tmp_path / "m").glob("part-*")).read_text())
    assert metrics["ingested"] == 12 and metrics["duration_seconds"] > 0
    assert sum(c["size"] for c in metrics["clusters"].values()) == 12
    assert metrics["queries_generated"] == got.count()
    assert jobs.run_queries(spark, str(path), domain="nowhere").count() == 0


def test_report_job(spark):
    queries = spark.createDataFrame([("q1", "t1", "Why was the refund late?", "refund", 3, "antecedent")],
                                    "query_id string, transcript_id string, query string, event_type string, complexity_level int, lehnert_category string")
    episodes = spark.createDataFrame([("t1", "x", "Turn 1: Agent: your refund\nTurn 2: Customer: late")], "id string, text string, text_with_turns string")
    row = jobs.run_report(queries, episodes).first()
    assert tuple(row) == ("q1", "Why was the refund late?", "refund", 3, "Turns 1-2", fixed.OFFLINE_REASON, 3.67, "strong", "antecedent")


def test_report_keeps_every_valid_query_and_maps_events(spark):
    queries = spark.createDataFrame(
        [("q1", "t1", "Why was the refund late?", "late refund", "churn", 3, "antecedent"),
         ("q2", "none", "Why was the refund late?", "late refund", "churn", 3, "antecedent"),
         ("q3", "t1", "Short", "", "", 9, "antecedent")],
        "query_id string, transcript_id string, query string, causal_trigger string, causal_outcome string, "
        "complexity_level int, lehnert_category string")
    queries = queries.withColumn("query", F.when(F.col("query") != "Short", F.lit(
        "Why did the agent cause a late refund that led the customer to churn in the end?")).otherwise(F.col("query")))
    episodes = spark.createDataFrame(
        [("t1", "x", "Turn 1: Agent: your refund\nTurn 2: Customer: late", "Billing Support")],
        "id string, text string, text_with_turns string, domain string")
    rows = {r.Query_ID: r for r in jobs.run_report(queries, episodes).collect()}
    assert "q3" not in rows and set(rows) == {"q1", "q2"}
    assert rows["q1"].Query_Category == "refund" and rows["q1"].Evidence_Location == "Turns 1-2"
    assert rows["q2"].Evidence_Location == "N/A" and rows["q2"].Evidence_Quality == "weak"


def test_failed_calls_leave_their_reason(spark):
    def factory():
        def client(prompt, system_prompt=None):
            if prompt == "bad":
                raise TimeoutError("no answer")
            return prompt.upper()
        return client

    df = spark.createDataFrame([("good",), ("bad",), (None,)], "prompt string")
    got = {r.prompt: (r.response, r.failure) for r in completion.complete(df, "prompt", factory, error="failure", parallel_calls=2).collect()}
    assert got == {"good": ("GOOD", None), "bad": (None, "TimeoutError: no answer"), None: (None, None)}


def test_all_seeds_and_the_first_ones(spark):
    df = spark.createDataFrame([(i, f"label{i}", ["phrase"]) for i in range(9)], "cluster_id int, action_label string, key_phrases array<string>")
    seeds = generation.seeds(df)
    assert generation.expand_seeds(seeds).count() == 9 * len(fixed.SEED_TEMPLATES)
    assert generation.expand_seeds(seeds, max_seeds=fixed.MAX_SEEDS).count() == fixed.MAX_SEEDS


def test_tone_reads_all_texts_unless_told(spark):
    rows = [(0, i, "bad" if i < 20 else "good") for i in range(80)]
    df = spark.createDataFrame(rows, "cluster int, id int, text string")
    lexicon = spark.createDataFrame([("good", 0.5), ("bad", -0.7), ("bad", -0.7)], "word string, polarity double")
    assert profile.tone(df, lexicon).first().tone == "positive"
    assert profile.tone(df, lexicon, 20).first().tone == "negative"


def test_one_row_is_one_cluster(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<float>")
    assert [(r.id, r.cluster) for r in embedding.cluster(rows).collect()] == [(1, 0)]
    assert embedding.cluster(rows.limit(0)).count() == 0


def counting_client(folder, broken=()):
    def factory():
        def client(prompt, system_prompt=None, **options):
            with open(f"{folder}/calls", "a") as calls:
                calls.write(prompt + "\n")
            if prompt in broken:
                raise ValueError("no")
            if prompt == "die" and not os.path.exists(f"{folder}/lives"):
                os._exit(1)
            return None if prompt == "silent" else f"{system_prompt}/{prompt}"
        return client
    return factory


def calls(folder):
    with open(f"{folder}/calls") as file:
        return sorted(file.read().split())


def test_answers_are_paid_for_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(completion, "_CALLS_A_TASK", 3)
    log = str(tmp_path / "log")
    rows = [(i, f"p{i % 20}") for i in range(60)] + [(60, None), (61, "silent"), (62, "bad")]
    df = spark.createDataFrame(rows, "n int, prompt string").repartition(4)
    factory = counting_client(str(tmp_path), {"bad"})

    def run(frame, **more):
        found = completion.complete(frame, "prompt", factory, error="why", system_prompt="s", parallel_calls=2, log=log, **more)
        assert found.columns == [*frame.columns, "response", "why"]
        return {r.n: (r.response, r.why) for r in found.collect()}

    expected = {n: (None, "ValueError: no") if p == "bad" else (None if p in (None, "silent") else f"s/{p}", None) for n, p in rows}
    assert run(df) == expected
    assert calls(tmp_path) == sorted({p for _, p in rows if p})
    # A later run asks what is new, and what failed.
    more = df.union(spark.createDataFrame([(100, "new"), (101, "p3")], "n int, prompt string"))
    assert run(more) == expected | {100: ("s/new", None), 101: ("s/p3", None)}
    assert sorted(set(calls(tmp_path)) ^ {p for _, p in rows if p}) == ["new"] and len(calls(tmp_path)) == 22 + 2
    # Other options are other questions.
    assert run(df.where("n = 5"), temperature=0.5) == {5: ("s/p5", None)} and len(calls(tmp_path)) == 25


def test_a_run_that_breaks_off_keeps_its_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(completion, "_CALLS_A_TASK", 2)
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)] + [(40, "die")], "n int, prompt string")
    factory, log = counting_client(str(tmp_path)), str(tmp_path / "log")
    with pytest.raises(Exception):
        completion.complete(df, "prompt", factory, parallel_calls=2, log=log)
    asked = len(calls(tmp_path))
    kept = spark.read.parquet(log).count() if (tmp_path / "log").exists() else 0
    (tmp_path / "lives").touch()
    found = completion.complete(df, "prompt", factory, parallel_calls=2, log=log)
    assert {r.n: r.response for r in found.collect()} == {**{i: f"None/p{i}" for i in range(40)}, 40: "None/die"}
    assert len(calls(tmp_path)) == asked + 41 - kept


def test_starts_run_side_by_side_on_sparse_vectors(spark, monkeypatch):
    """A start waits for another one, so starts that follow each other would break the barrier."""
    import threading
    barrier, kinds, real = threading.Barrier(2, timeout=60), [], embedding.KMeans

    class Together(real):
        def fit(self, points):
            kinds.append(type(points.first()["_features"]).__name__)
            barrier.wait()
            return super().fit(points)

    monkeypatch.setattr(embedding, "KMeans", Together)
    rows = [(i, [0.0] * (i % 3) + [1.0] + [0.0] * (15 - i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    got = embedding.cluster(df, k=3, restarts=2).groupBy("cluster").count().collect()
    assert sorted(map(tuple, got)) == [(0, 10), (1, 10), (2, 10)] and kinds == ["SparseVector"] * 2
