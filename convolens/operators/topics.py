"""Topics and phrases of question-answer pairs.

Input: ``query``, ``response`` and the ordinal ``qa_pos``; with ``by``, one result per group.
Words are counted on the map side first, so a frequent word or a large group moves only as counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import ascii_words, ngrams, strip, without
from .explode import explode_positions, explode_values
from .profile import first_per_group


_NUMBER = "decimal(38,0)"


def _place(phase: int, qa_pos: Column | None = None, at: Column | None = None) -> Column:
    """A place in reading order as one number, which a hash aggregate can keep the smallest of."""
    place = F.lit(str(10 ** 34 * phase)).cast(_NUMBER)
    if qa_pos is None:
        return place
    whole = (qa_pos.cast("decimal(19,0)") * F.lit(10 ** 12).cast("decimal(13,0)")).cast(_NUMBER)
    return (place + whole + at.cast(_NUMBER)).cast(_NUMBER)


def _top(counted: DataFrame, by: list[str], score: str, n: int) -> DataFrame:
    order = [F.desc(score), F.asc("first_seen")]
    if by:
        return first_per_group(counted, by, order, n)
    top = counted.orderBy(*order).limit(n)
    ranked = top.agg(F.sort_array(F.collect_list(
        F.struct((-F.col(score)).alias("key"), "first_seen", *[c for c in counted.columns if c != "first_seen"])
    )).alias("rows"))
    return ranked.select(F.posexplode("rows").alias("p", "r")).select(
        "r.*", (F.col("p") + 1).alias("rank")
    ).drop("key")


def topic_counts(qa: DataFrame, by: list[str] | None = None, actions: DataFrame | None = None,
                 words_per_text: int | None = fixed.TOPIC_WORDS_PER_TEXT) -> DataFrame:
    """Counts and score per topic word.

    The first ``words_per_text`` kept words of every query and response count (all for None), repeats included. ``actions``
    holds ``action_label`` (and the ``by`` columns); the label counts twice for both sides.
    """
    by = by or []

    def side(text: str, phase: int, stop: list[str]) -> Column:
        kept = without(ascii_words(F.col(text), 4), stop)
        if words_per_text is not None:
            kept = F.slice(kept, 1, words_per_text)
        return F.transform(F.coalesce(kept, F.array().cast("array<string>")), lambda word, at: F.struct(
            word.alias("topic"),
            F.lit(1 - phase).cast("bigint").alias("q"),
            F.lit(phase).cast("bigint").alias("r"),
            _place(phase, F.col("qa_pos"), at).alias("seen"),
        ))

    both = F.concat(
        side("query", 0, fixed.QUERY_TOPIC_STOP_WORDS), side("response", 1, fixed.RESPONSE_TOPIC_STOP_WORDS)
    )
    terms = explode_values(qa, by, both, "term").select(*by, "term.*")
    if actions is not None:
        bump = F.lit(fixed.ACTION_BUMP).cast("bigint")
        label = strip(F.lower("action_label"))
        terms = terms.unionByName(actions.where(F.coalesce("action_label", F.lit("")) != "").select(
            *by, label.alias("topic"), bump.alias("q"), bump.alias("r"),
            _place(2).alias("seen"),
        ))
    counted = terms.groupBy(*by, "topic").agg(
        F.sum("q").alias("query_count"), F.sum("r").alias("response_count"),
        F.min("seen").alias("first_seen"),
    )
    score = F.col("query_count") * F.lit(fixed.QUERY_WEIGHT) + F.col("response_count") * F.lit(fixed.RESPONSE_WEIGHT)
    return counted.withColumn("score", score)


def topics(qa: DataFrame, by: list[str] | None = None, actions: DataFrame | None = None,
           n: int = fixed.N_TOPICS, words_per_text: int | None = fixed.TOPIC_WORDS_PER_TEXT) -> DataFrame:
    """Best topics by score; equal scores keep the order of first appearance."""
    top = _top(topic_counts(qa, by, actions, words_per_text), by or [], "score", n)
    return top.select(*(by or []), "rank", "topic", "query_count", "response_count", "score")


def phrases(qa: DataFrame, by: list[str] | None = None, n: int = fixed.N_PHRASES,
            response_chars: int | None = fixed.PHRASE_RESPONSE_CHARS) -> DataFrame:
    """Most frequent word pairs and triples over query and the first ``response_chars`` of the response.

    A phrase may span the border between the two. Ties keep the order of first appearance:
    by pair, pairs of words before triples, then by position.
    """
    by = by or []
    response = F.coalesce("response", F.lit(""))
    combined = F.concat(
        F.lower(F.coalesce("query", F.lit(""))), F.lit(" "),
        F.lower(response if response_chars is None else F.substring(response, 1, response_chars)),
    )
    tokens = qa.select(*by, "qa_pos", ascii_words(combined, 3).alias("w"))
    grams = F.concat(ngrams(F.col("w"), 2), ngrams(F.col("w"), 3))
    found = explode_positions(tokens, [*by, "qa_pos"], grams, "at", "phrase")
    seen = F.min(_place(0, F.col("qa_pos"), F.col("at"))).alias("first_seen")
    counted = found.groupBy(*by, "phrase").agg(F.count("*").alias("n"), seen)
    return _top(counted, by, "n", n).select(*by, "rank", "phrase", "n")
