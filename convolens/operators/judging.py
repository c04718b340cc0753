"""Scores of queries: rubric, decision, statistics and the final report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, prompts, rules
from .completion import complete_structured
from .evidence import location

SCORE_SCHEMA = (
    "causal_depth int, clarity int, business_value int, aggregate_score double, "
    "decision string, reasoning string"
)


def mean_score(depth: Column, clarity: Column, value: Column) -> Column:
    return (depth + clarity + value) / F.lit(3.0)


def decision(mean: Column, accept_above: float = fixed.ACCEPT_ABOVE) -> Column:
    """The mean decides before it is rounded."""
    return F.when(mean > accept_above, "ACCEPT").otherwise("REJECT")


def with_decision(scores: DataFrame, accept_above: float = fixed.ACCEPT_ABOVE) -> DataFrame:
    """(Re)compute ``aggregate_score`` and ``decision`` from the three scores."""
    mean = mean_score(F.col("causal_depth"), F.col("clarity"), F.col("business_value"))
    return scores.withColumn("_mean", mean).withColumns({
        "aggregate_score": F.round("_mean", 2), "decision": decision(F.col("_mean"), accept_above),
    }).drop("_mean")


def _constant(values: tuple[int, int, int], reason: str) -> Column:
    depth, clarity, value = values
    return F.struct(
        F.lit(depth).alias("causal_depth"), F.lit(clarity).alias("clarity"),
        F.lit(value).alias("business_value"), F.lit(reason).alias("reasoning"),
    )


def judge(queries: DataFrame, client_factory: Callable | None = None,
          accept_above: float = fixed.ACCEPT_ABOVE, log: str | None = None) -> DataFrame:
    """Scores for rows with ``query``, ``event_type`` and ``context``.

    Without a client every query gets the fixed offline scores; an answer that fails or does
    not pass its ranges gets the lowest ones.
    """
    if client_factory is None:
        chosen = queries.withColumn("_s", _constant(fixed.OFFLINE_SCORES, fixed.OFFLINE_REASON))
    else:
        asked = queries.withColumn(
            "_prompt", prompts.judge(F.col("query"), F.col("event_type"), F.col("context"))
        )
        answered = complete_structured(
            asked, "_prompt", client_factory, SCORE_SCHEMA,
            lambda r: rules.scores_in_range(
                r["causal_depth"], r["clarity"], r["business_value"], r["aggregate_score"]
            ) & rules.known_decision(r["decision"]) & r["reasoning"].isNotNull(),
            out="_r", system_prompt=prompts.JUDGE_ROLE, log=log,
        )
        given = F.when(
            F.col("_r").isNotNull(),
            F.struct("_r.causal_depth", "_r.clarity", "_r.business_value", "_r.reasoning"),
        )
        chosen = answered.withColumn(
            "_s", F.coalesce(given, _constant(fixed.FAILED_SCORES, fixed.FAILED_REASON))
        )
    return with_decision(chosen.select(*queries.columns, "_s.*"), accept_above)


def acceptance_rate(scores: DataFrame) -> DataFrame:
    """Share of accepted rows, 0 without rows."""
    accepted = F.when(F.col("decision") == "ACCEPT", 1.0).otherwise(0.0)
    return scores.agg(F.coalesce(F.avg(accepted), F.lit(0.0)).alias("acceptance_rate"))


def average_scores(scores: DataFrame) -> DataFrame:
    """Means of the scores, 0 without rows."""
    names = [("causal_depth", "causal_depth"), ("clarity", "clarity"),
             ("business_value", "business_value"), ("aggregate_score", "aggregate")]
    return scores.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(out) for c, out in names])


def check_queries(queries: DataFrame) -> DataFrame:
    """Add ``violations`` and ``valid`` to rows with the fields of a causal query."""
    found = rules.violations(
        F.col("query"), F.col("causal_trigger"), F.col("causal_outcome"), F.col("complexity_level")
    )
    return queries.withColumn("violations", found).withColumn("valid", F.size("violations") == 0)


def report_rows(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """Report rows of queries that carry their scores and evidence.

    A query without scores or evidence stays, with the lowest scores and weak evidence.
    """
    depth, clarity, value = fixed.FAILED_SCORES
    failed = round((depth + clarity + value) / 3, 2)
    return rows.select(
        F.col(key).cast("string").alias("Query_ID"),
        F.col("query").alias("Query"),
        F.col("event_type").alias("Query_Category"),
        F.col("complexity_level").alias("Complexity_Level"),
        location(F.col("agent_turn"), F.col("customer_response_turn")).alias("Evidence_Location"),
        F.coalesce("reasoning", F.lit(fixed.FAILED_REASON)).alias("Remarks"),
        F.coalesce("aggregate_score", F.lit(failed)).alias("Validation_Score"),
        F.coalesce("evidence_quality", F.lit("weak")).alias("Evidence_Quality"),
        F.col("lehnert_category").alias("Lehnert_Category"),
    )


def report(queries: DataFrame, scores: DataFrame, evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """Report rows of queries whose scores and evidence are tables of their own, joined on ``key``."""
    return report_rows(queries.join(scores, key, "left").join(evidence, key, "left"), key)
