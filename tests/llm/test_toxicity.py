import math
import random
import zlib

import pytest

from convolens.llm import toxicity
from convolens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, judged string"


def contexts(text, weights=None):
    scorer = toxicity.Scorer(weights or {"idiot": 5.0})
    return [(word, context) for _, word, context, _ in scorer.matches(text)]


def test_machine_marks_contexts():
    assert contexts("what an idiot") == [("idiot", "")]
    assert contexts("you are an idiot") == [("idiot", "+")]
    assert contexts("this is not an idiot") == [("idiot", "-")]
    assert contexts("not one of all those idiot things") == [("idiot", "")]
    assert contexts("somebody said what an idiot") == [("idiot", "~")]
    assert contexts("somebody said it is not an idiot") == [("idiot", "-~")]
    assert contexts("i will kill you") == [("kill", "+")]
    assert contexts("i will never kill you") == [("kill", "+-")]
    assert contexts("the plants kill. you may go") == []
    assert contexts("") == []


def test_contexts_cross_punctuation():
    assert contexts('he said: "you idiot"') == [("idiot", "+~")]
    assert contexts("she claimed, you are an idiot") == [("idiot", "+~")]
    assert contexts('he said: "fool me. you idiot" but you idiot') == [("idiot", "+~"), ("idiot", "+")]
    assert contexts('he said: "never\nyou idiot') == [("idiot", "+")]
    assert contexts("he said so. you idiot") == [("idiot", "+")]
    assert contexts('the "idiot" box') == [("idiot", "")]
    assert contexts("not, in any way, an idiot") == [("idiot", "-")]
    assert contexts("not an, idiot") == [("idiot", "-")]
    assert contexts("no, you idiot") == [("idiot", "+")]
    assert contexts("you may, idiot") == [("idiot", "")]
    assert contexts("i would not kill. you idiot") == [("idiot", "+")]


@pytest.mark.parametrize("weight", [5.0, 50.0])
def test_only_clauses_decide(weight):
    scorer = toxicity.Scorer({"idiot": weight, "moron": weight})
    for text in ("somebody said what an idiot", 'he said: "you idiot"', "she claimed, you are an idiot", "not, in any way, an idiot",
                 "idiot", "the word idiot is a noun", "idiot, idiot. idiot", ""):
        assert scorer.score(text)[0] < 0.5, text
    for text in ("you are an idiot", "idiot moron", "an idiot. a moron", "he is here. you idiot, you moron", "no, you idiot"):
        assert scorer.score(text)[0] > 0.5, text


def plain_evidence(scorer, text):
    """What the clauses give, by one list of all matches."""
    found = [(c, w, x, min(v, toxicity.WEIGHT_MOST) * scorer.scales[x]) for c, w, x, v in scorer.matches(text)]
    total = sum(v for c, w, v in {(c, w, v) for c, w, x, v in found if x == "+"})
    for word in {w for _, w, _, _ in found} - {w for _, w, x, _ in found if x == "+"}:
        total += min(scorer.lone, max(v for _, w, _, v in found if w == word))
    return total


def test_scores_equal_plain_sums():
    rng = random.Random(5)
    parts = ["idiot", "moron", "kill", "you", "not", "said", "word", ",", ".", '"', "\n", ":"]
    scorer = toxicity.Scorer({"idiot": 5.0, "moron": 3.0})
    for _ in range(3000):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 14)))
        score, clauses, top = scorer.score(text)
        assert score == pytest.approx(1 / (1 + math.exp(3.5 - plain_evidence(scorer, text))))
        assert (clauses > 0) == (top is not None) and (top is None or top in text)


def test_lone_words_decide_where_labels_say_so(spark):
    def learned(label):
        docs = spark.createDataFrame([(i, f"grumpf word{i}", "x", "s", "j") for i in range(1, 200)], SCHEMA)
        rows = docs.selectExpr("text", f"{label} AS toxic")
        return toxicity.learn_scales(rows, {"grumpf": 5.0})[1]
    assert learned("1") > -toxicity.BIAS > learned("cast(doc_id % 2 as int)") > learned("0")


def test_result_names_in_the_table(spark):
    docs = spark.createDataFrame([(1, "you idiot", 7, True, "j"), (2, None, None, None, None)],
                                 "doc_id long, text string, score long, held_out boolean, predicted string")
    scorer = toxicity.Scorer({"idiot": 5.0})
    assert [(r.doc_id, r.predicted) for r in toxicity.score_documents(docs, scorer).orderBy("doc_id").collect()] == [(1, 1), (2, 0)]
    left = toxicity.reject_toxic(docs, scorer)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]


def test_composition_equals_running_in_turn():
    import itertools
    parts = [toxicity.negation_transducer(), toxicity.report_transducer(), toxicity.target_transducer()]
    machine = toxicity.grammar()
    for symbols in itertools.product(toxicity.SYMBOLS, repeat=4):
        states, state, one, other = [0, 0, 0], 0, [], []
        for symbol in symbols:
            state, out = machine[state, symbol]
            one.append(out)
            for i, arcs in enumerate(parts):
                states[i], symbol = arcs.get((states[i], symbol), (states[i], symbol))
            other.append(symbol)
        assert one == other


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, None, None, "x"), (2, "", "en", "s", None), (3, "you idiot, you moron", None, None, "x"),
            (None, "fine words", "en", "s", "x"), (3, "you idiot, you moron", None, None, "x"),
            (4, "fine. " * 200_000 + "scum and moron and idiot", "en", "s", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scorer = toxicity.learn(docs, labels)
    got = {(r.doc_id, r.predicted) for r in toxicity.score_documents(docs, scorer).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (None, 0), (4, 1)}
    left = toxicity.reject_toxic(docs, scorer)
    assert left.columns == docs.columns and left.count() == 3
    assert toxicity.score_documents(docs.limit(0), scorer).count() == 0


def test_labels_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame(
        [(i, f"grumpf word{i}" if i % 3 == 0 else f"nice word{i}", "x", "s", "j") for i in range(1, 300)], SCHEMA)
    labels = spark.createDataFrame(
        [(i, 1, int(i % 3 == 0)) for i in range(1, 300)] + [(3, 0, 1), (4, None, None), (None, 1, 1)],
        "doc_id long, quality int, toxic int")
    scorer = toxicity.learn(docs, labels)
    assert scorer.weights["grumpf"] > toxicity.MIN_WEIGHT and "nice" not in scorer.weights
    for row in toxicity.score_documents(docs, scorer).collect():
        assert row.predicted == int(row.doc_id % 3 == 0)
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_held_out_labels_teach_nothing(spark):
    rows = [(i, "zorg text", "x", "s", "j") for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1, 1) for r in rows], "doc_id long, quality int, toxic int")
    assert "zorg" not in toxicity.learn(docs, labels).weights


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, folder):
    scores = QUERIES["op10_toxicity"][0](spark, folder)
    joined = scores.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, clean = joined[joined.toxic == 1], joined[joined.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.75
    assert (clean.predicted == 1).mean() < 0.01
