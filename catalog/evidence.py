"""Fuzzy matching and evidence queries."""

from pyspark.sql import functions as F

from convolens.functions.fuzzy import contained, keyword_scores
from convolens.functions.text import keywords
from convolens.operators import evidence
from convolens.operators.explode import explode_values

from . import bindings as B
from .normalise import keywords_sql
from .registry import query

EXACT_VIEWS = ("raw", "split_docs", "rendered", "pairs", "found_turn")
B.VIEWS["found_turn"] = f"""
  SELECT doc_id, ts, list_min(list_transform(list_filter(ts, lambda t: contains(t.speaker, 'agent') AND length(t.words) > 0
           AND len(list_filter(k, lambda w: contains(t.words, w) OR contains(w, t.words))) > 0), lambda t: t.number)) AS agent_turn
  FROM (SELECT doc_id, {keywords_sql('query')} AS k, {B.TURN_LIST.format('transcript')} AS ts FROM pairs)"""
EXACT_EVIDENCE = """
  SELECT doc_id, agent_turn, customer_response_turn, CASE WHEN agent_turn IS NULL THEN 'weak' ELSE 'strong' END AS evidence_quality,
         CASE WHEN agent_turn IS NULL THEN 0.0::DOUBLE WHEN customer_response_turn IS NULL THEN 0.5 ELSE 1.0 END AS grounding_confidence
  FROM (SELECT doc_id, agent_turn, list_min(list_transform(list_filter(ts, lambda t: t.number > agent_turn
               AND contains(t.speaker, 'customer')), lambda t: t.number)) AS customer_response_turn FROM found_turn)"""


@query("m12_evidence_exact", B.sql(EXACT_EVIDENCE, *EXACT_VIEWS))
def m12_exact(spark, d):
    return evidence.ground(B.pairs(spark, d), 100).drop("query", "transcript", "domain", "score")


@query("m12_evidence")
def m12(spark, d):
    return evidence.ground(B.pairs(spark, d)).drop("query", "transcript", "domain")


_ASKED = f"""SELECT conv_id, number AS query_number, {keywords_sql('text')} AS k FROM turns WHERE speaker = 'Customer'"""
_W3 = f"""
SELECT conv_id, query_number, min(number) AS agent_turn, 100.0::DOUBLE AS score FROM (
  SELECT a.conv_id, a.query_number, a.k, t.number, lower(t.text) AS text FROM ({_ASKED}) a JOIN turns t USING (conv_id) WHERE contains(lower(t.speaker), 'agent'))
WHERE length(text) > 0 AND len(list_filter(k, lambda w: contains(text, w) OR contains(w, text))) > 0 GROUP BY conv_id, query_number"""


def _questions(spark, d):
    """Every customer turn as a query to its conversation."""
    asked = B.turns(spark, d).where("speaker = 'Customer'")
    return asked.select(F.struct("conv_id", "number").alias("query_id"), "conv_id", F.col("text").alias("query"))


def _by_number(found):
    return found.withColumn("query_number", F.col("query_id.number")).drop("query_id")


@query("w3_best_turn_exact", B.sql(_W3, "turns"))
def w3_exact(spark, d):
    return _by_number(evidence.best_agent_turns(_questions(spark, d), B.turns(spark, d), 100))


@query("w3_best_turn")
def w3(spark, d):
    return _by_number(evidence.ground_turns(_questions(spark, d), B.turns(spark, d)))


@query("f5_match_threshold", """SELECT event_id, value > 0 AND value >= 85 AS at_default, value > 0 AND value >= 0 AS at_zero FROM events""")
def f5(spark, d):
    return B.table(spark, d, "events").select(
        "event_id", evidence.passes(F.col("value")).alias("at_default"), evidence.passes(F.col("value"), 0).alias("at_zero"))


@query("j5_next_customer_turn", B.sql("""
SELECT conv_id, number, min(CASE WHEN contains(lower(speaker), 'customer') THEN number END)
  OVER (PARTITION BY conv_id ORDER BY number RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS customer_response_turn FROM turns""", "turns"))
def j5(spark, d):
    return evidence.next_customer_turns(B.turns(spark, d))


@query("j4_pairing", B.sql("SELECT doc_id, md5(query) AS query, md5(transcript) AS transcript FROM pairs", "raw", "split_docs", "rendered", "pairs"))
def j4(spark, d):
    items = B.table(spark, d, "benchmark").select("item_id", F.concat(F.lit("Why "), F.col("text")).alias("query"))
    docs = B.rendered(spark, d).withColumn("item_id", F.col("doc_id") % items.agg(F.count("*")).scalar())
    return evidence.pair(items, docs, "item_id").select("doc_id", F.md5("query").alias("query"), F.md5("text_with_turns").alias("transcript"))


@query("x3_contained", B.sql(f"""
SELECT conv_id, turn, pos, unnest(k) AS keyword, contains(lower(text), unnest(k)) OR contains(unnest(k), lower(text)) AS hit
FROM (SELECT c.conv_id, c.turn, c.pos, t.text, {keywords_sql('c.full_query')} AS k FROM cand c
      JOIN conversations t ON t.conv_id = c.conv_id AND t.turn = c.turn + 1)""", "cand"))
def x3_exact(spark, d):
    following = B.table(spark, d, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("text"))
    asked = B.cand(spark, d).join(following, ["conv_id", "turn"])
    words = explode_values(asked, ["conv_id", "turn", "pos", "text"], keywords(F.col("full_query")), "keyword")
    return words.select("conv_id", "turn", "pos", "keyword", contained(F.col("keyword"), F.col("text")).alias("hit"))


@query("x3_partial_ratio")
def x3(spark, d):
    following = B.table(spark, d, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("text"))
    asked = B.cand(spark, d).join(following, ["conv_id", "turn"])
    best = keyword_scores(keywords(F.col("full_query")), F.array("text"))
    return asked.select("conv_id", "turn", "pos", F.round(F.get(best, F.lit(0)), 6).alias("score"))


@query("x5_quality", "SELECT event_id, CASE WHEN value >= 95 THEN 'strong' WHEN value >= 80 THEN 'moderate' ELSE 'weak' END AS quality FROM events")
def x5(spark, d):
    return B.table(spark, d, "events").select("event_id", evidence.quality(F.col("value")).alias("quality"))


@query("x6_confidence", "SELECT event_id, round(least((value + CASE WHEN user_id % 2 = 0 THEN 100 ELSE 0 END) / 200.0::DOUBLE, 1.0), 6) AS confidence FROM events")
def x6(spark, d):
    score = evidence.confidence(F.col("value"), F.col("user_id") % 2 == 0)
    return B.table(spark, d, "events").select("event_id", F.round(score, 6).alias("confidence"))


@query("x7_location", """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'N/A' WHEN role = 'user' THEN 'Turn ' || turn ELSE 'Turns ' || turn || '-' || turn + 1 END AS location
FROM conversations""")
def x7(spark, d):
    rows = B.table(spark, d, "conversations")
    agent = F.when(F.col("role") != "system", F.col("turn"))
    reply = F.when(F.col("role") == "assistant", F.col("turn") + 1)
    return rows.select("conv_id", "turn", evidence.location(agent, reply).alias("location"))


@query("x8_no_evidence", B.sql(f"SELECT doc_id, evidence_quality, grounding_confidence FROM ({EXACT_EVIDENCE}) WHERE agent_turn IS NULL", *EXACT_VIEWS))
def x8(spark, d):
    found = evidence.ground(B.pairs(spark, d), 100).where("agent_turn is null")
    return found.select("doc_id", "evidence_quality", "grounding_confidence")
