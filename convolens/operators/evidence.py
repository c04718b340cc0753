"""Which turns support a query.

The best agent turn is the earliest one whose text holds any keyword best; the customer's next
turn after it is the response. Exact hits are settled in the JVM; only what they leave open goes
through the Arrow scorer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.fuzzy import contained, keyword_scores
from ..functions.text import keywords
from ..functions.turns import parse_turns, speaker_has

_TURN_BLOCK = 4096


def quality(score: Column) -> Column:
    return (
        F.when(score >= fixed.STRONG_FROM, "strong")
        .when(score >= fixed.MODERATE_FROM, "moderate")
        .otherwise("weak")
    )


def confidence(score: Column, has_response: Column) -> Column:
    response = F.when(has_response, 100.0).otherwise(0.0)
    return F.least((score + response) / 200.0, F.lit(1.0))


def location(agent_turn: Column, response_turn: Column) -> Column:
    agent, response = agent_turn.cast("string"), response_turn.cast("string")
    return (
        F.when(agent_turn.isNull(), "N/A")
        .when(response_turn.isNull(), F.concat(F.lit("Turn "), agent))
        .otherwise(F.concat(F.lit("Turns "), agent, F.lit("-"), response))
    )


def passes(score, threshold: float = fixed.MATCH_THRESHOLD):
    """A score counts as evidence from the threshold on, and never at zero."""
    return (score > 0) & (score >= threshold)


def _with_grades(rows: DataFrame) -> DataFrame:
    """From ``agent_turn``, ``customer_response_turn`` and ``score`` (NULL without evidence)."""
    found = F.col("agent_turn").isNotNull()
    return rows.select(
        "*",
        F.when(found, quality(F.col("score"))).otherwise("weak").alias("evidence_quality"),
        F.when(found, confidence(F.col("score"), F.col("customer_response_turn").isNotNull()))
        .otherwise(0.0).alias("grounding_confidence"),
    )


def ground(pairs: DataFrame, threshold: float = fixed.MATCH_THRESHOLD) -> DataFrame:
    """Evidence for rows that hold a ``query`` and its turn-numbered ``transcript``.

    A transcript is one row, so nothing is shuffled. With a threshold of 100 only exact hits
    count and no Python runs.
    """
    empty = F.array().cast("array<string>")
    rows = (
        pairs.withColumn("_turns", parse_turns(F.col("transcript")))
        .withColumn("_words", F.array_distinct(keywords(F.col("query"))))
        .withColumn("_agent", F.filter("_turns", lambda t: speaker_has(t["speaker"], "agent")))
        .withColumn("_texts", F.transform("_agent", lambda t: F.lower(t["text"])))
        .withColumn("_hits", F.transform(
            "_texts", lambda text: F.exists("_words", lambda w: contained(w, text))))
        .withColumn("_exact", F.array_position("_hits", F.lit(True)))
    )
    if threshold >= 100:
        at, score = F.nullif("_exact", F.lit(0)), F.lit(100.0)
    else:
        is_open = F.coalesce(F.col("_exact"), F.lit(0)) == 0
        rows = rows.withColumn("_scores", keyword_scores(
            F.when(is_open, F.coalesce("_words", empty)).otherwise(empty),
            F.when(is_open, F.coalesce("_texts", empty)).otherwise(empty), threshold,
        ))
        top = F.array_max("_scores")
        good = passes(top, threshold)
        at = F.when(is_open, F.when(good, F.array_position("_scores", top))).otherwise(F.col("_exact"))
        score = F.when(is_open, top).otherwise(100.0)
    rows = rows.withColumn("_at", at.cast("int")).withColumn(
        "score", F.when(F.col("_at").isNotNull(), score)
    ).withColumn("agent_turn", F.get("_agent", F.col("_at") - 1)["number"])
    response = F.filter(
        "_turns", lambda t: (t["number"] > F.col("agent_turn")) & speaker_has(t["speaker"], "customer")
    )
    rows = rows.withColumn("customer_response_turn", F.get(response, F.lit(0))["number"])
    return _with_grades(rows.select(*pairs.columns, "agent_turn", "customer_response_turn", "score"))


def best_agent_turns(queries: DataFrame, turns: DataFrame,
                     threshold: float = fixed.MATCH_THRESHOLD) -> DataFrame:
    """Best agent turn per query over a table of turns: ``query_id, conv_id, agent_turn, score``.

    ``queries`` has ``query_id, conv_id, query``; ``turns`` has ``conv_id, number, speaker, text``
    with numbers rising through a conversation. Each query is held against its own conversation;
    the winner is a plain min or max, so tasks reduce before the shuffle and a long conversation
    can be split.
    """
    asked = queries.select(
        "query_id", "conv_id", F.array_distinct(keywords(F.col("query"))).alias("words")
    ).where(F.size("words") > 0)
    agent = turns.where(speaker_has(F.col("speaker"), "agent")).select(
        "conv_id", "number", F.lower("text").alias("text")
    )
    hit = F.exists("words", lambda w: contained(w, F.col("text")))
    exact = (
        asked.join(agent, "conv_id").where(hit)
        .groupBy("query_id", "conv_id").agg(F.min("number").alias("agent_turn"))
        .withColumn("score", F.lit(100.0))
    )
    if threshold >= 100:
        return exact
    scored = (
        asked.join(exact, ["query_id", "conv_id"], "left_anti").join(agent, "conv_id")
        .withColumn("score", F.get(keyword_scores(F.col("words"), F.array("text"), threshold), F.lit(0)))
        .where(passes(F.col("score"), threshold))
    )
    order = F.struct("score", (-F.col("number")).alias("earlier"))
    fuzzy = scored.groupBy("query_id", "conv_id").agg(
        F.max_by("number", order).alias("agent_turn"), F.max("score").alias("score")
    )
    return exact.unionByName(fuzzy)


def next_customer_turns(turns: DataFrame, block: int = _TURN_BLOCK) -> DataFrame:
    """``conv_id, number, customer_response_turn``: the first later customer turn of every turn.

    Numbers rise through a conversation. The search runs inside blocks of turns, then over one
    row per block, so that a conversation of any length is split over tasks.
    """
    is_customer = speaker_has(F.col("speaker"), "customer")
    marked = turns.select(
        "conv_id", "number", F.when(is_customer, F.col("number")).alias("customer"),
        F.floor(F.col("number") / block).alias("block"),
    )
    after = Window.partitionBy("conv_id", "block").orderBy("number").rangeBetween(1, Window.unboundedFollowing)
    inside = marked.withColumn("here", F.min("customer").over(after))
    later = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = (
        marked.groupBy("conv_id", "block").agg(F.min("customer").alias("first"))
        .withColumn("beyond", F.min("first").over(later))
        .select("conv_id", "block", "beyond")
    )
    return inside.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "number", F.coalesce("here", "beyond").alias("customer_response_turn")
    )


def ground_turns(queries: DataFrame, turns: DataFrame,
                 threshold: float = fixed.MATCH_THRESHOLD) -> DataFrame:
    """Evidence per query over a table of turns; queries without any keep the weak default."""
    best = best_agent_turns(queries, turns, threshold)
    replies = next_customer_turns(turns).withColumnRenamed("number", "agent_turn")
    found = best.join(replies, ["conv_id", "agent_turn"], "left")
    return _with_grades(
        queries.select("query_id", "conv_id").join(found, ["query_id", "conv_id"], "left")
        .select("query_id", "conv_id", "agent_turn", "customer_response_turn", "score")
    )


def pair(queries: DataFrame, transcripts: DataFrame, key: str) -> DataFrame:
    """Queries with their transcripts by an explicit key; unmatched rows of either side drop."""
    return queries.join(transcripts, key)
