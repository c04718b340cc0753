"""Rules a causal query and its scores must keep, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import word_count


def not_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def short_enough(query: Column, limit: int = fixed.MAX_QUERY_WORDS) -> Column:
    return word_count(F.coalesce(query, F.lit(""))) <= limit


def question_form(query: Column) -> Column:
    """Starts like why/how (a prefix test: "however" passes), or like what plus a causal verb."""
    q = F.lower(F.coalesce(query, F.lit("")))
    causal_what = q.startswith("what") & q.rlike("|".join(fixed.CAUSAL_VERBS))
    return q.startswith("why") | q.startswith("how") | causal_what


def not_trivial(query: Column) -> Column:
    return ~F.lower(F.coalesce(query, F.lit(""))).rlike("|".join(fixed.TRIVIAL_PHRASES))


def not_factual(query: Column) -> Column:
    q = F.lower(F.coalesce(query, F.lit("")))
    return ~(q.rlike(fixed.FACTUAL_PATTERNS[0]) | q.rlike(fixed.FACTUAL_PATTERNS[1]))


def specific_trigger(trigger: Column) -> Column:
    return not_empty(trigger) & ~F.lower(trigger).isin(fixed.GENERIC_TRIGGERS)


def specific_outcome(outcome: Column) -> Column:
    return not_empty(outcome) & ~F.lower(outcome).isin(fixed.GENERIC_OUTCOMES)


def complexity_in_range(level: Column) -> Column:
    return F.coalesce(level.between(2, 5), F.lit(False))


def scores_in_range(depth: Column, clarity: Column, value: Column, aggregate: Column) -> Column:
    checks = [c.between(1, 5) for c in (depth, clarity, value)] + [aggregate.between(1.0, 5.0)]
    return F.coalesce(checks[0] & checks[1] & checks[2] & checks[3], F.lit(False))


def known_decision(decision: Column) -> Column:
    return F.coalesce(decision.isin(fixed.DECISIONS), F.lit(False))


def known_quality(quality: Column) -> Column:
    return F.coalesce(quality.isin(fixed.QUALITIES), F.lit(False))


def confidence_in_range(confidence: Column) -> Column:
    return F.coalesce(confidence.between(0.0, 1.0), F.lit(False))


def query_violations(query: Column) -> list[tuple[str, Column]]:
    """Rules on the query text, in the order in which the first broken one is reported."""
    return [
        ("empty", not_empty(query)),
        ("too_long", short_enough(query)),
        ("question_form", question_form(query)),
        ("trivial", not_trivial(query)),
        ("factual", not_factual(query)),
    ]


def violations(query: Column, trigger: Column, outcome: Column, level: Column) -> Column:
    """Names of the broken rules: at most one for the query text, then one per other field."""
    first = F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in query_violations(query)])
    found = F.array(
        first,
        F.when(~specific_trigger(trigger), F.lit("trigger")),
        F.when(~specific_outcome(outcome), F.lit("outcome")),
        F.when(~complexity_in_range(level), F.lit("complexity")),
    )
    return F.array_compact(found)


def length_in_band(query: Column) -> Column:
    n = word_count(query)
    return (n > fixed.MIN_WORDS_EXCLUSIVE) & (n < fixed.MAX_WORDS_EXCLUSIVE)
