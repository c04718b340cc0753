"""Rules on queries and scores, judging and the final report."""

from pyspark.sql import functions as F

from convolens.functions import fixed, prompts, rules
from convolens.operators import evidence, judging
from convolens.operators.generation import dedupe, keep_length_band

from . import bindings as B
from .evidence import EXACT_EVIDENCE, EXACT_VIEWS
from .registry import query

_WORDS = r"len(regexp_extract_all({}, '\S+'))"
_EMPTY = "coalesce(query, '') <> ''"
_SHORT = _WORDS.format("query") + " <= 50"
_FORM = (
    "(starts_with(lower(query), 'why') OR starts_with(lower(query), 'how') OR (starts_with(lower(query), 'what') "
    f"AND regexp_matches(lower(query), '{'|'.join(fixed.CAUSAL_VERBS)}')))"
)
_TRIVIAL = f"NOT regexp_matches(lower(query), '{'|'.join(fixed.TRIVIAL_PHRASES)}')"
_FACTUAL = "NOT (" + " OR ".join(f"regexp_matches(lower(query), '{p}')" for p in fixed.FACTUAL_PATTERNS) + ")"
_TRIGGER = f"(coalesce(causal_trigger, '') <> '' AND lower(causal_trigger) NOT IN ({B.quoted(fixed.GENERIC_TRIGGERS)}))"
_OUTCOME = f"(coalesce(causal_outcome, '') <> '' AND lower(causal_outcome) NOT IN ({B.quoted(fixed.GENERIC_OUTCOMES)}))"
_LEVEL = "complexity_level BETWEEN 2 AND 5"


def _rule(name, condition, make):
    @query(name, B.sql(f"SELECT conv_id, turn, pos, {condition} AS ok FROM cand", "cand"))
    def run(spark, d):
        return B.cand(spark, d).select("conv_id", "turn", "pos", make().alias("ok"))


_rule("f6_not_empty", _EMPTY, lambda: rules.not_empty(F.col("query")))
_rule("f7_short_enough", _SHORT, lambda: rules.short_enough(F.col("query")))
_rule("f8_question_form", _FORM, lambda: rules.question_form(F.col("query")))
_rule("f9_not_trivial", _TRIVIAL, lambda: rules.not_trivial(F.col("query")))
_rule("f10_not_factual", _FACTUAL, lambda: rules.not_factual(F.col("query")))
_rule("f11_trigger", _TRIGGER, lambda: rules.specific_trigger(F.col("causal_trigger")))
_rule("f12_outcome", _OUTCOME, lambda: rules.specific_outcome(F.col("causal_outcome")))
_rule("f13_complexity", _LEVEL, lambda: rules.complexity_in_range(F.col("complexity_level")))

_FIRST = (
    f"CASE WHEN NOT ({_EMPTY}) THEN 'empty' WHEN NOT ({_SHORT}) THEN 'too_long' WHEN NOT {_FORM} THEN 'question_form' "
    f"WHEN NOT ({_TRIVIAL}) THEN 'trivial' WHEN NOT ({_FACTUAL}) THEN 'factual' END"
)


@query("f13b_rule_check", B.sql(f"""
SELECT conv_id, turn, pos, violations, violations = '' AS valid FROM (
  SELECT conv_id, turn, pos, concat_ws(',', {_FIRST}, CASE WHEN NOT {_TRIGGER} THEN 'trigger' END,
         CASE WHEN NOT {_OUTCOME} THEN 'outcome' END, CASE WHEN NOT {_LEVEL} THEN 'complexity' END) AS violations FROM cand)""", "cand"))
def f13b(spark, d):
    checked = judging.check_queries(B.cand(spark, d))
    return checked.select("conv_id", "turn", "pos", F.array_join("violations", ",").alias("violations"), "valid")


_RATED = """SELECT doc_id, causal_depth + doc_id % 2 AS causal_depth, clarity, business_value,
  round((causal_depth + clarity + business_value) / 3.0, 2) AS aggregate_score FROM scores"""


def _rated(spark, d):
    rated = judging.with_decision(B.scores(spark, d))
    return rated.withColumn("causal_depth", F.col("causal_depth") + F.col("doc_id") % 2)


@query("f14_score_ranges", B.sql(f"""SELECT doc_id, causal_depth BETWEEN 1 AND 5 AND clarity BETWEEN 1 AND 5
  AND business_value BETWEEN 1 AND 5 AND aggregate_score BETWEEN 1 AND 5 AS ok FROM ({_RATED})""", "scores"))
def f14(spark, d):
    ok = rules.scores_in_range(*[F.col(c) for c in ("causal_depth", "clarity", "business_value", "aggregate_score")])
    return _rated(spark, d).select("doc_id", ok.alias("ok"))


_NAMES = ["ACCEPT", "REJECT", "accept", None]
_GRADES = ["strong", "moderate", "weak", "Weak"]


@query("f15_enums", f"""SELECT doc_id, coalesce(dec IN ('ACCEPT', 'REJECT'), false) AS decision_ok, q IN ('strong', 'moderate', 'weak') AS quality_ok
FROM (SELECT doc_id, {B.sql_case('doc_id % 4', _NAMES)} AS dec, {B.sql_case('(doc_id + quality) % 4', _GRADES)} AS q FROM labels)""")
def f15(spark, d):
    labels = B.table(spark, d, "labels")
    dec, grade = B.case(F.col("doc_id") % 4, _NAMES), B.case((F.col("doc_id") + F.col("quality")) % 4, _GRADES)
    return labels.select("doc_id", rules.known_decision(dec).alias("decision_ok"), rules.known_quality(grade).alias("quality_ok"))


@query("f16_confidence", "SELECT event_id, value / 10 BETWEEN 0.0 AND 1.0 AS ok FROM events")
def f16(spark, d):
    return B.table(spark, d, "events").select("event_id", rules.confidence_in_range(F.col("value") / 10).alias("ok"))


_BAND = _WORDS.format("full_query") + " BETWEEN 11 AND 29"


@query("f17_length_band", B.sql(f"""
SELECT conv_id, turn, pos, full_query AS query FROM cand
WHERE {_BAND} OR NOT (SELECT coalesce(bool_or({_BAND}), false) FROM cand)""", "cand"))
def f17(spark, d):
    rows = B.cand(spark, d).select("conv_id", "turn", "pos", F.col("full_query").alias("query"))
    return keep_length_band(rows)


@query("f17_fallback", "SELECT conv_id, turn, role AS query FROM conversations")
def f17_fallback(spark, d):
    return keep_length_band(B.table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("query")))


@query("d1_dedupe_queries", B.sql("""
SELECT query, first.conv_id AS conv_id, first.turn AS turn, first.pos AS pos FROM (
  SELECT query, min({'conv_id': conv_id, 'turn': turn, 'pos': pos}) AS first FROM cand GROUP BY query)""", "cand"))
def d1(spark, d):
    unique = dedupe(B.cand(spark, d).select("query", "conv_id", "turn", "pos"), ["conv_id", "turn", "pos"])
    return unique.select("query", "ordinal.conv_id", "ordinal.turn", "ordinal.pos")


_MEAN = "(causal_depth + clarity + business_value) / 3.0::DOUBLE"
_JUDGED = f"SELECT *, round({_MEAN}, 2) AS aggregate_score, CASE WHEN {_MEAN} > 3.5 THEN 'ACCEPT' ELSE 'REJECT' END AS decision FROM scores"


@query("a11_decision", B.sql(f"SELECT doc_id, aggregate_score, decision FROM ({_JUDGED})", "scores"))
def a11(spark, d):
    return judging.with_decision(B.scores(spark, d)).select("doc_id", "aggregate_score", "decision")


@query("a9_acceptance_rate", B.sql(f"SELECT round(coalesce(avg(CASE WHEN decision = 'ACCEPT' THEN 1.0::DOUBLE ELSE 0 END), 0), 9) AS acceptance_rate FROM ({_JUDGED})", "scores"))
def a9(spark, d):
    rate = judging.acceptance_rate(judging.with_decision(B.scores(spark, d)))
    return rate.select(F.round("acceptance_rate", 9).alias("acceptance_rate"))


@query("a10_average_scores", B.sql(f"""SELECT round(avg(causal_depth), 6) AS causal_depth, round(avg(clarity), 6) AS clarity,
  round(avg(business_value), 6) AS business_value, round(avg(aggregate_score), 6) AS aggregate FROM ({_JUDGED})""", "scores"))
def a10(spark, d):
    means = judging.average_scores(judging.with_decision(B.scores(spark, d)))
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


@query("m6_judge_offline", B.sql(f"""SELECT doc_id, 4 AS causal_depth, 4 AS clarity, 3 AS business_value, 3.67::DOUBLE AS aggregate_score,
  'ACCEPT' AS decision, '{fixed.OFFLINE_REASON}' AS reasoning FROM pairs""", "raw", "split_docs", "rendered", "pairs"))
def m6_offline(spark, d):
    rows = B.pairs(spark, d).select("doc_id", "query", F.lit("general").alias("event_type"), F.col("transcript").alias("context"))
    return judging.judge(rows).drop("query", "event_type", "context")


def scoring_client():
    """Answers by the length of the prompt; every fifth answer is no JSON, every seventh out of range."""
    def client(prompt, system_prompt=None, **options):
        n = len(prompt)
        if n % 5 == 0:
            return "sorry"
        depth = 9 if n % 7 == 0 else 1 + n % 4
        return (f'{{"causal_depth": {depth}, "clarity": {1 + n % 3}, "business_value": 5, '
                '"aggregate_score": 3.0, "decision": "REJECT", "reasoning": "by length"}')
    return client


_PROMPT = B.sql_fill(prompts.JUDGE_PROMPT, query="query", event="'refund'", context="substring(full_query, 1, 500)")
_GRADED = f"""SELECT conv_id, turn, pos, n % 5 > 0 AND n % 7 > 0 AS ok, 1 + n % 4 AS depth, 1 + n % 3 AS clear
  FROM (SELECT conv_id, turn, pos, length({_PROMPT}) AS n FROM cand)"""


@query("m6_judge_client", B.sql(f"""
SELECT conv_id, turn, pos, CASE WHEN ok THEN depth ELSE 1 END AS causal_depth, CASE WHEN ok THEN clear ELSE 1 END AS clarity,
  CASE WHEN ok THEN 5 ELSE 1 END AS business_value, CASE WHEN ok THEN round((depth + clear + 5) / 3.0::DOUBLE, 2) ELSE 1 END AS aggregate_score,
  CASE WHEN ok AND (depth + clear + 5) / 3.0::DOUBLE > 3.5 THEN 'ACCEPT' ELSE 'REJECT' END AS decision,
  CASE WHEN ok THEN 'by length' ELSE '{fixed.FAILED_REASON}' END AS reasoning FROM ({_GRADED})""", "cand"))
def m6_client(spark, d):
    rows = B.cand(spark, d).select(
        "conv_id", "turn", "pos", "query", F.lit("refund").alias("event_type"), F.col("full_query").alias("context"))
    return judging.judge(rows, scoring_client).drop("query", "event_type", "context")


@query("r1_report", B.sql(f"""
SELECT p.doc_id::VARCHAR AS "Query_ID", p.query AS "Query", 'general' AS "Query_Category", 2 + p.doc_id % 4 AS "Complexity_Level",
  CASE WHEN e.agent_turn IS NULL THEN 'N/A' WHEN e.customer_response_turn IS NULL THEN 'Turn ' || e.agent_turn
       ELSE 'Turns ' || e.agent_turn || '-' || e.customer_response_turn END AS "Evidence_Location",
  CASE WHEN s.doc_id IS NULL THEN '{fixed.FAILED_REASON}' ELSE 'from labels' END AS "Remarks", coalesce(s.aggregate_score, 1.0::DOUBLE) AS "Validation_Score", e.evidence_quality AS "Evidence_Quality", 'antecedent' AS "Lehnert_Category"
FROM pairs p LEFT JOIN ({_JUDGED}) s USING (doc_id) LEFT JOIN ({EXACT_EVIDENCE}) e USING (doc_id)""", *EXACT_VIEWS, "scores"))
def r1(spark, d):
    pairs = B.pairs(spark, d)
    queries = pairs.select("doc_id", "query", F.lit("general").alias("event_type"),
                           (2 + F.col("doc_id") % 4).alias("complexity_level"), F.lit("antecedent").alias("lehnert_category"))
    scores = judging.with_decision(B.scores(spark, d)).withColumn("reasoning", F.lit("from labels"))
    found = evidence.ground(pairs, 100).drop("query", "transcript", "domain", "score")
    return judging.report(queries, scores, found, key="doc_id")
