"""Physical plans: what must not be in them, and that Python stays where it belongs."""

import ast
import pathlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from convolens.operators import evidence, linking, profile, topics
from convolens.scale import spread

ROOT = pathlib.Path(__file__).parent.parent
FOLDER = "/root/testdata/sf0.001"
# Queries that start jobs of model training or completion before they return.
EAGER = {"m1_embed", "m2_cluster", "m2_numbering", "m2_one_cluster", "m13_analyze", "m13_one_cluster", "m14_query_job", "m15_followup_job", "m10_fuse", "a15_profiles"}
PYTHON = {"m12_evidence", "w3_best_turn", "x3_partial_ratio",
          # Cells that are no JSON are tried as Python literals.
          "a12_load_stats", "f3_empty_conversation", "p4_python_literal", "p8_row_metadata", "p18_episodes", "s1_csv_scan", "s4_rejected_rows"}
OWN = {n for n in contract.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
SAMPLE = sorted(OWN - EAGER)[::4] + ["j1_link_qa", "j3_nearest_label", "m12_evidence_exact", "j2_seeds"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SAMPLE)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(contract.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert ("EvalPython" in text) == (name in PYTHON)


def test_scan_reads_only_what_is_needed(spark):
    text = plan(contract.queries()["f4_speaker_contains"](spark, FOLDER))
    assert re.search(r"ReadSchema: struct<conv_id:bigint,turn:bigint,role:string>", text)
    text = plan(spark.read.parquet(f"{FOLDER}/conversations.parquet").where("role = 'user'").select("turn"))
    assert "EqualTo(role,user)" in text


def test_top_rows_are_limited_before_the_shuffle(spark, table):
    rows = table("embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"))
    text = plan(profile.first_per_group(rows, "cluster", [F.asc("id")], 3))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_grounding_text_shuffles_nothing(spark):
    df = spark.range(10).select(F.lit("Why refund").alias("query"), F.lit("Turn 1: Agent: refund").alias("transcript"))
    assert "Exchange" not in plan(evidence.ground(df)) and "EvalPython" not in plan(evidence.ground(df, 100))


def test_linking_few_needles_shuffles_no_pairs(spark):
    clusters = spark.createDataFrame([(0, "a", ["b"])], "cluster_id int, action_label string, key_phrases array<string>")
    qa = spark.range(10).select(F.col("id").alias("qa_pos"), F.lit("a b").alias("query"), F.lit("c").alias("response"))
    assert "Exchange hashpartitioning" not in plan(linking.match_pairs(clusters, qa))


def test_words_are_counted_before_the_shuffle(spark):
    qa = spark.range(10).select(F.col("id").alias("qa_pos"), F.lit("aaaa bbbb").alias("query"), F.lit("cccc").alias("response"))
    text = plan(topics.topic_counts(qa))
    assert "partial_sum" in text and text.index("Exchange") < text.index("partial_sum")


def test_words_and_phrases_are_counted_without_sorting(spark):
    qa = spark.range(10).select(F.col("id").alias("qa_pos"), F.lit("aaaa bbbb").alias("query"), F.lit("cccc").alias("response"))
    for df in (topics.topic_counts(qa), topics.phrases(qa)):
        text = plan(df)
        assert "HashAggregate" in text and "SortAggregate(key=[" not in text


def test_linked_pairs_are_deduplicated_without_sorting(spark):
    clusters = spark.createDataFrame([(0, "a", ["b"])], "cluster_id int, action_label string, key_phrases array<string>")
    qa = spark.range(10).select(F.col("id").alias("qa_pos"), F.lit("a b").alias("query"), F.lit("c").alias("response"))
    text = plan(linking.link_qas(clusters, qa))
    assert "HashAggregate(keys=[cluster_id" in text and "SortAggregate(key=[" not in text and "max_by" not in text


def test_words_of_a_text_are_looked_up_where_it_lies(spark):
    texts = spark.range(10).repartition(4).select((F.col("id") % 2).alias("cluster"), "id", F.lit("good bad day").alias("text"))
    lexicon = spark.createDataFrame([("good", 0.5), ("bad", -0.25)], "word string, polarity double")
    text = plan(profile.tone(texts, lexicon))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    # Below the exchange by text only the partial means of a task's own words are made.
    assert text.count("Exchange hashpartitioning") == 2 and "hashpartitioning(word" not in text
    assert [round(r.polarity, 3) for r in profile.tone(texts, lexicon).collect()] == [0.125, 0.125]


def test_rows_of_one_group_are_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(16).write.parquet(str(tmp_path / "many"))
    one, many = (spark.read.parquet(str(tmp_path / name)) for name in ("one", "many"))
    assert spread(one).select(F.spark_partition_id()).distinct().count() == 8 and spread(many) is many
    assert sorted(r.id for r in spread(one).collect()) == list(range(1000))


def test_every_query_with_sql_has_a_callable():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_code_takes_no_shortcuts():
    """No local checkpoint, no RDD work, no collecting of unbounded data."""
    for path in (ROOT / "convolens").rglob("*.py"):
        calls = [n.func.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)]
        assert not {"localCheckpoint", "crossJoin", "toPandas", "toLocalIterator", "mapPartitions"} & set(calls), path


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 8 and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, 9))


@pytest.mark.parametrize("name", ["a15_profiles", "p17_summary", "a5_key_phrases", "w1_exemplars"])
def test_utterances_are_joined_once(spark, name):
    """Several steps read them, so they are written first."""
    files = contract.queries()[name](spark, FOLDER).inputFiles()
    assert not any("documents.parquet" in file for file in files)


def test_beginnings_are_cut_in_one_pass_of_a_text(spark):
    clusters = spark.createDataFrame([(0, "abcde", ["😀x", "ü"]), (1, "xy\nz", ["q"])], "cluster_id int, action_label string, key_phrases array<string>")
    qa = spark.createDataFrame([(1, "y" * 50_000 + "ABCDE", None), (2, "a😀X", "b"), (3, "no", "tail xy\nz"), (4, "Ü", "q")], "qa_pos int, query string, response string")
    found = linking.match_pairs(clusters, qa, 0).select("cluster_id", "qa_pos")
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 2), (0, 4), (1, 3)]
    # Substrings by position walk from the beginning of the text each time.
    assert "sequence(" not in plan(found)
