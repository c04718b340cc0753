"""The three jobs: queries from transcripts, follow-ups from question-answer pairs, the report."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.events import event_of_domain
from ..functions.text import excerpt
from ..operators import evidence, followups, generation, judging, linking, profile, topics
from ..operators.embedding import cluster, embed
from ..scale import cut, keep
from ..sources import sinks
from ..sources.json_transcripts import load_utterances

LEXICON_SCHEMA = "word string, polarity double"


def ontology_vectors(spark: SparkSession, make_encoder: Callable, ontology: dict[str, str]) -> DataFrame:
    """Labels with the vectors of their descriptions, from the encoder the utterances use."""
    rows = [(i, name, text) for i, (name, text) in enumerate(ontology.items())]
    described = spark.createDataFrame(rows, "pos int, label string, text string")
    return embed(described, make_encoder).select("pos", "label", F.col("embedding").alias("vector"))


def analyze(utterances: DataFrame, lexicon: DataFrame | None = None, make_encoder: Callable | None = None,
            outcomes: DataFrame | None = None, ontology: dict[str, str] | None = None,
            k: int | None = None, restarts: int = 10) -> DataFrame:
    """Cluster profiles of utterances with ``id, text, speaker``.

    Without an encoder, utterances and label descriptions are hashed together, so that their
    term weights agree.
    """
    spark = utterances.sparkSession
    ontology = ontology or fixed.ACTION_ONTOLOGY
    if make_encoder is not None:
        embedded = keep(embed(utterances, make_encoder))
        labels = ontology_vectors(spark, make_encoder, ontology)
    else:
        rows = [(name, i, text) for i, (name, text) in enumerate(ontology.items())]
        described = spark.createDataFrame(rows, "label string, pos int, text string")
        both = keep(embed(utterances.unionByName(described, allowMissingColumns=True)))
        embedded = both.where("label is null").drop("label", "pos")
        labels = both.where("label is not null").select("pos", "label", F.col("embedding").alias("vector"))
    assigned = keep(cluster(embedded, k=k, restarts=restarts))
    if lexicon is None:
        lexicon = spark.createDataFrame([], LEXICON_SCHEMA)
    return profile.profile_clusters(assigned, cut(labels), lexicon, outcomes)


def utterance_ids(utterances: DataFrame, max_transcripts: int | None = None) -> DataFrame:
    """Give loaded utterances an ``id`` that follows the reading order, for the first transcripts only if asked."""
    if max_transcripts is not None:
        first = utterances.select("source", "dialog_pos").distinct().orderBy("source", "dialog_pos").limit(max_transcripts)
        utterances = utterances.join(first, ["source", "dialog_pos"], "left_semi")
    order = F.struct("source", "dialog_pos", "pos")
    return utterances.select(order.alias("id"), "conv_id", "text", "speaker")


def run_queries(spark: SparkSession, transcripts: str | DataFrame, output_csv: str | None = None,
                output_metrics: str | None = None, max_transcripts: int | None = None,
                domain: str | None = None, client_factory: Callable | None = None,
                lines: bool = False, answer_log: str | None = None, **analysis) -> DataFrame:
    """Transcripts -> clusters -> queries (``rank, query``), with optional CSV and metrics files.

    ``transcripts`` is a path of JSON documents, of JSON Lines with ``lines``, or an utterance
    DataFrame in their form. The metrics count documents and lines that could not be read. Answers that
    the folder ``answer_log`` holds are not asked for again.
    """
    started = datetime.now(timezone.utc)
    rejected = None
    if isinstance(transcripts, str):
        read = load_utterances(spark, transcripts, domain, lines)
        transcripts, rejected = read.utterances, read.rejected
    utterances = keep(utterance_ids(transcripts, max_transcripts))
    if utterances.isEmpty():
        return spark.createDataFrame([], "rank int, query string")
    clusters = cut(analyze(utterances, **analysis))
    queries = cut(generation.generate_queries(clusters, client_factory, log=answer_log))
    if output_csv:
        sinks.write_queries_csv(queries, output_csv)
    if output_metrics:
        ended = datetime.now(timezone.utc)
        stats = {
            "ingested": utterances.count(),
            "rejected": 0 if rejected is None else rejected.count(),
            "clusters_found": clusters.count(),
            "queries_generated": queries.count(),
            "start_time": started.isoformat(),
            "end_time": ended.isoformat(),
            "duration_seconds": (ended - started).total_seconds(),
        }
        sinks.write_metrics_json(clusters, stats, output_metrics)
    return queries


def cluster_topics(clusters: DataFrame, linked: DataFrame) -> DataFrame:
    """Ordered topics per cluster over its linked pairs, the action label included."""
    ranked = topics.topics(linked, by=["cluster_id"], actions=clusters.select("cluster_id", "action_label"))
    return ranked.groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda t: t["topic"]).alias("topics")
    )


def run_followups(clusters: DataFrame, qa: DataFrame, client_factory: Callable | None = None,
                  output_csv: str | None = None, answer_log: str | None = None) -> DataFrame:
    """Clusters and pairs -> topics, concepts, fused text and follow-up questions per cluster.

    Answers that the folder ``answer_log`` holds are not asked for again.
    """
    clusters = cut(clusters)
    linked = cut(linking.link_qas(clusters, qa))
    none = F.array().cast("array<string>")
    rows = (
        clusters.select("cluster_id", "action_label")
        .join(cluster_topics(clusters, linked), "cluster_id", "left")
        .join(linking.qa_context(linked), "cluster_id", "left")
        .withColumn("topics", F.coalesce("topics", none))
    )
    enriched = followups.select_concepts(cut(rows), client_factory, answer_log)
    enriched = followups.fuse(enriched, client_factory, answer_log)
    enriched = followups.generate_followups(enriched, client_factory, log=answer_log)
    if answer_log:
        enriched = cut(enriched)
    if output_csv:
        sinks.write_followups_csv(enriched, output_csv)
    return enriched


def run_report(queries: DataFrame, episodes: DataFrame, client_factory: Callable | None = None,
               threshold: float = fixed.MATCH_THRESHOLD, answer_log: str | None = None) -> DataFrame:
    """Queries (``query_id, transcript_id, query, complexity_level, lehnert_category``) and their
    episodes -> report rows with scores and evidence.

    One join brings a query and its episode together; evidence and scores are added to that row. A
    query without an episode stays, with weak evidence. Without ``event_type`` the event follows from
    the episode's domain. Queries that carry ``causal_trigger`` and ``causal_outcome`` are checked by
    the rules, and those that break one are left out. Scores that ``answer_log`` holds are not asked for again.
    """
    if {"causal_trigger", "causal_outcome"} <= set(queries.columns):
        queries = judging.check_queries(queries).where("valid").drop("violations", "valid")
    about = [F.col("domain").alias("_domain")] if "domain" in episodes.columns else []
    told = episodes.select(
        F.col("id").alias("transcript_id"), excerpt(F.col("text")).alias("context"),
        F.col("text_with_turns").alias("transcript"), *about,
    )
    rows = queries.join(told, "transcript_id", "left")
    if "event_type" not in queries.columns:
        domain = F.col("_domain") if about else F.lit(None).cast("string")
        rows = rows.withColumn("event_type", event_of_domain(domain))
    found = evidence.ground(rows, threshold).drop("transcript", "score", "transcript_id", "_domain")
    return judging.report_rows(judging.judge(found, client_factory, log=answer_log))
