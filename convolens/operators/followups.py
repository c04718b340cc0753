"""Concepts, fused understanding and follow-up questions per cluster.

Rows: one per cluster with ``cluster_id``, ``action_label``, ``topics`` and ``qas``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, prompts, sections
from .completion import complete


def select_concepts(clusters: DataFrame, client_factory: Callable | None = None, log: str | None = None) -> DataFrame:
    """Add ``concepts``; clusters without topics are not asked and have none."""
    prompt = F.when(
        F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0,
        prompts.select_concepts(F.col("action_label"), F.col("topics"), F.col("qas")),
    )
    answered = complete(
        clusters.withColumn("_prompt", prompt), "_prompt", client_factory, "_answer",
        log=log, max_tokens=400, temperature=0.2,
    )
    return answered.withColumn("concepts", sections.concept_map(F.col("_answer"))).drop("_prompt", "_answer")


def fuse(clusters: DataFrame, client_factory: Callable | None = None, log: str | None = None) -> DataFrame:
    """Add ``fused``, the answer as it is."""
    prompt = prompts.fuse(F.col("action_label"), F.col("topics"), F.col("concepts"), F.col("qas"))
    return complete(
        clusters.withColumn("_prompt", prompt), "_prompt", client_factory, "fused",
        log=log, max_tokens=400, temperature=0.2,
    ).drop("_prompt")


def generate_followups(clusters: DataFrame, client_factory: Callable | None = None,
                       limit: int = fixed.MAX_FOLLOWUPS, log: str | None = None) -> DataFrame:
    """Add ``followups``, the questions parsed from the answer."""
    prompt = prompts.ask_followups(F.col("action_label"), F.col("topics"), F.col("fused"), F.col("qas"))
    answered = complete(
        clusters.withColumn("_prompt", prompt), "_prompt", client_factory, "_answer",
        log=log, max_tokens=400, temperature=0.6,
    )
    return answered.withColumn("followups", sections.followups(F.col("_answer"), limit)).drop("_prompt", "_answer")


def followup_rows(clusters: DataFrame) -> DataFrame:
    """One row per question. ``followups`` holds structs or bare strings."""
    is_text = dict(clusters.dtypes)["followups"] == "array<string>"
    question = F.col("f") if is_text else F.coalesce("f.question", F.lit(""))
    category = F.lit(fixed.OTHER_CATEGORY) if is_text else F.coalesce("f.category", F.lit(fixed.OTHER_CATEGORY))
    topics = F.coalesce(F.array_join(F.slice("topics", 1, 3), ", "), F.lit(""))
    return clusters.select(
        "cluster_id", F.coalesce("action_label", F.lit("unknown")).alias("action_label"),
        topics.alias("related_topics"), F.posexplode("followups").alias("p", "f"),
    ).select(
        "cluster_id", "action_label", (F.col("p") + 1).alias("question_number"),
        question.alias("question"), category.alias("category"), "related_topics",
    )
