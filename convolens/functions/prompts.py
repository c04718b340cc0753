"""Prompt texts as string expressions, and the short question-answer context they carry.

``qas`` arguments are ARRAY<STRUCT<query, response>> columns in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import excerpt, shorten


SEED_PROMPT = (
    f"Write {fixed.QUERIES_PER_SEED} different, specific causal questions that build on this one: '{{seed}}'. "
    "Aim at root causes and effects on the business. One question per line, nothing else."
)

CONCEPT_PROMPT = """You know billing, subscriptions, refunds, payments and contact centers well.
Name concepts behind the cluster below that its questions and answers do not state themselves.

Cluster: {action}
Topics: {topics}

Questions and answers:
{qas}

List three root causes (process faults, bottlenecks), three impacts (customer experience,
revenue, service levels) and three patterns (conditions under which the issue shows up).
Stay close to the evidence and invent no figures.

Answer in exactly this form:

ROOT_CAUSES:
- ...

IMPACTS:
- ...

PATTERNS:
- ...
"""

FUSION_PROMPT = """Explain how the issue below comes about, from the concepts and the evidence given.

Cluster: {action}
Topics: {topics}

Root causes: {causal}
Impacts: {impact}
Patterns: {pattern}

Questions and answers:
{qas}

Give one causal chain of three steps, three insights that join the concepts with the evidence,
and two directions for further analysis of the transcripts.

Answer in exactly this form:

CAUSAL_CHAIN:
- A → B → C → Outcome

INSIGHTS:
- ...

INVESTIGATION:
- ...
"""

FOLLOWUP_PROMPT = """Write three follow-up questions for analysts of the cluster below. Each must need domain
knowledge, rest on the evidence or the concepts, and lead to an investigation.

Cluster: {action}
Topics: {topics}

What is known:
{fused}

Questions and answers:
{qas}

The first asks for a root cause several steps upstream, the second for an effect that can be
measured in the data, the third for conditions that occur together.

Answer in exactly this form:

QUESTION_1:
...

QUESTION_2:
...

QUESTION_3:
...
"""

JUDGE_ROLE = "You grade causal questions about customer-service transcripts."

JUDGE_PROMPT = """Grade the question on three scales from 1 to 5.

Question: {query}
Event: {event}
Context: {context}...

causal_depth: 5 finds the root cause of {event}, 3 a correlation, 1 is not causal.
clarity: 5 is one unambiguous question, 3 leaves doubt, 1 cannot be understood.
business_value: 5 can be acted on, 3 helps general analysis, 1 is of no use.

Grade each scale on its own, give a short reason, and mark down what the transcript cannot answer.
Answer as a JSON object with the fields causal_depth, clarity, business_value, aggregate_score,
decision (ACCEPT or REJECT) and reasoning."""


def _qa_block(qas: Column, n: int, query: callable, response: callable, empty: str) -> Column:
    parts = F.transform(
        F.slice(qas, 1, n),
        lambda qa, i: F.concat(
            F.lit("Q"), (i + 1).cast("string"), F.lit(": "), query(F.coalesce(qa["query"], F.lit(""))),
            F.lit("\nA"), (i + 1).cast("string"), F.lit(": "),
            response(F.coalesce(qa["response"], F.lit(""))), F.lit("\n\n"),
        ),
    )
    text = F.array_join(parts, "")
    return F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(text)


def qa_for_concepts(qas: Column) -> Column:
    """Three pairs, query cut at 60 and response at 120 characters, always with an ellipsis."""
    return _qa_block(
        qas, 3,
        lambda q: F.substring(q, 1, 60),
        lambda r: F.concat(F.substring(r, 1, 120), F.lit("...")),
        "No QA data available",
    )


def qa_for_fusion(qas: Column) -> Column:
    """Three pairs, responses over 150 characters cut."""
    return _qa_block(qas, 3, lambda q: q, lambda r: shorten(r, 150), "No QA data available")


def qa_for_followups(qas: Column) -> Column:
    """Two pairs, responses over 100 characters cut."""
    return _qa_block(qas, 2, lambda q: q, lambda r: shorten(r, 100), "No additional context")


def fill(template: str, **values: Column) -> Column:
    """Replace ``{name}`` slots; the template is split so that values are never scanned."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def _first(items: Column, n: int) -> Column:
    return F.coalesce(F.array_join(F.slice(items, 1, n), ", "), F.lit(""))


def expand_seed(seed: Column) -> Column:
    return fill(SEED_PROMPT, seed=seed)


def select_concepts(action: Column, topics: Column, qas: Column) -> Column:
    return fill(CONCEPT_PROMPT, action=action, topics=_first(topics, 5), qas=qa_for_concepts(qas))


def fuse(action: Column, topics: Column, concepts: Column, qas: Column) -> Column:
    """``concepts`` is the MAP<category, ARRAY<STRING>> of ``sections.concept_map``."""
    two = {name: _first(F.element_at(concepts, F.lit(name)), 2) for name in fixed.CATEGORIES}
    return fill(FUSION_PROMPT, action=action, topics=_first(topics, 4), qas=qa_for_fusion(qas), **two)


def ask_followups(action: Column, topics: Column, fused: Column, qas: Column) -> Column:
    return fill(
        FOLLOWUP_PROMPT, action=action, topics=_first(topics, 5), fused=fused, qas=qa_for_followups(qas)
    )


def judge(query: Column, event: Column, context: Column) -> Column:
    return fill(JUDGE_PROMPT, query=query, event=event, context=excerpt(context))
