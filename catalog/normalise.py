"""Transcript parsing, normalisation and event queries."""

from pyspark.sql import functions as F

from convolens.functions import events, turns as T
from convolens.functions.text import ascii_words, excerpt, keywords, ngrams
from convolens.operators.events import with_event_overrides
from convolens.operators.explode import explode_positions, explode_values
from convolens.sources.csv_transcripts import pick, pick_domain, pick_id

from . import bindings as B
from .registry import query


def _columns(*names):
    return {n: F.col(n) for n in names}


@query("p1_transcript_id", B.sql("SELECT doc_id, coalesce(transcript_id, id, 'T_' || lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INTEGER, '0')) AS transcript_id FROM raw", "raw"))
def p1(spark, d):
    return B.raw(spark, d).select("doc_id", pick_id(_columns("transcript_id", "id"), F.col("doc_id")).alias("transcript_id"))


@query("p2_conversation_pick", B.sql("SELECT doc_id, md5(coalesce(domain, conversation)) AS picked FROM raw", "raw"))
def p2(spark, d):
    df = B.raw(spark, d)
    picked = pick({"conversation": F.col("domain"), "transcript": F.col("conversation")}, ["conversation", "Conversation", "transcript"])
    return df.select("doc_id", F.md5(picked).alias("picked"))


@query("p3_domain_default", B.sql("SELECT coalesce(domain, 'General') AS domain, count(*) AS n FROM raw GROUP BY 1", "raw"))
def p3(spark, d):
    return B.raw(spark, d).groupBy(pick_domain(_columns("domain")).alias("domain")).agg(F.count("*").alias("n"))


@query("p5_numbered_text", B.sql("SELECT doc_id, md5(text_with_turns) AS numbered, md5(text) AS plain FROM rendered", "raw", "split_docs", "rendered"))
def p5(spark, d):
    return B.rendered(spark, d).select("doc_id", F.md5("text_with_turns").alias("numbered"), F.md5("text").alias("plain"))


@query("p6_split_turns", B.sql("SELECT doc_id, unnest(ts) AS turn, generate_subscripts(ts, 1) AS number FROM split_docs", "raw", "split_docs"))
def p6(spark, d):
    split = explode_positions(B.raw(spark, d), ["doc_id"], T.split_plain_text(F.col("conversation")), "p", "turn")
    return split.select("doc_id", "turn", (F.col("p") + 1).alias("number"))


@query("p7_turn_count", B.sql("SELECT doc_id, turn_count FROM rendered", "raw", "split_docs", "rendered"))
def p7(spark, d):
    return B.rendered(spark, d).select("doc_id", "turn_count")


@query("p11_speaker_names", "SELECT CASE WHEN lower(role) IN ('user', 'customer', 'client') THEN 'user' ELSE 'system' END AS speaker, count(*) AS n FROM conversations GROUP BY 1")
def p11(spark, d):
    rows = B.table(spark, d, "conversations")
    return rows.groupBy(T.user_or_system(F.col("role")).alias("speaker")).agg(F.count("*").alias("n"))


@query("p13_parse_turns", B.sql("SELECT doc_id, number, speaker, text FROM doc_turns", "raw", "split_docs", "rendered", "doc_turns"))
def p13(spark, d):
    parsed = explode_values(B.rendered(spark, d), ["doc_id"], T.parse_turns(F.col("text_with_turns")), "t")
    return parsed.select("doc_id", "t.number", "t.speaker", "t.text")


def _event_sql(name):
    from convolens.functions.fixed import EVENT_BUCKETS

    arms = " ".join(f"WHEN regexp_matches(lower(trim({name})), '{'|'.join(stems)}') THEN '{event}'" for event, stems in EVENT_BUCKETS)
    return f"CASE WHEN coalesce({name}, '') = '' THEN 'general' {arms} ELSE 'general' END"


@query("p14_event_of_domain", B.sql(f"SELECT doc_id, {_event_sql('domain')} AS event_type FROM raw", "raw"))
def p14(spark, d):
    return B.raw(spark, d).select("doc_id", events.event_of_domain(F.col("domain")).alias("event_type"))


_LABELS = [" Churn ", "REFUND", "other", "compliance", "Escalation"]


@query("p15_sanitize_label", f"""
SELECT event_id, CASE WHEN lower(trim(label)) IN ('escalation', 'churn', 'refund', 'compliance') THEN lower(trim(label)) ELSE 'general' END AS label
FROM (SELECT event_id, {B.sql_case('user_id % 5', _LABELS)} AS label FROM events)""")
def p15(spark, d):
    label = B.case(F.col("user_id") % 5, _LABELS)
    return B.table(spark, d, "events").select("event_id", events.sanitize_event(label).alias("label"))


_OVERRIDE = ["Refund", "odd", "CHURN", "compliance ", "escalation"]


@query("j7_event_overrides", B.sql(f"""
SELECT doc_id, CASE WHEN o.event IS NULL THEN {_event_sql('r.name')}
                    WHEN lower(trim(o.event)) IN ('escalation', 'churn', 'refund', 'compliance') THEN lower(trim(o.event)) ELSE 'general' END AS event_type
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE domain END AS name FROM raw) r
LEFT JOIN (SELECT 'src' || n_nationkey AS name, {B.sql_case('n_nationkey % 5', _OVERRIDE)} AS event FROM nation) o ON o.name = lower(trim(r.name))""", "raw"))
def j7(spark, d):
    rows = B.raw(spark, d).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("domain")).alias("domain"))
    overrides = B.table(spark, d, "nation").select(
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("domain"),
        B.case(F.col("n_nationkey") % 5, _OVERRIDE).alias("event"))
    return with_event_overrides(rows, overrides).select("doc_id", "event_type")


@query("f4_speaker_contains", B.sql("SELECT conv_id, number, speaker FROM turns WHERE contains(lower(speaker), 'agent')", "turns"))
def f4(spark, d):
    return B.turns(spark, d).where(T.speaker_has(F.col("speaker"), "Agent")).select("conv_id", "number", "speaker")


@query("w10_turn_lines", B.sql("SELECT conv_id, number, 'Turn ' || number || ': ' || speaker || ': ' || text AS line FROM turns", "turns"))
def w10(spark, d):
    line = F.concat(F.lit("Turn "), F.col("number").cast("string"), F.lit(": "), T.label_turn(F.col("speaker"), F.col("text")))
    return B.turns(spark, d).select("conv_id", "number", line.alias("line"))


def _words_sql(column, n):
    return rf"list_filter(string_split_regex(lower({column}), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{{n},}}'))"


@query("x1_ascii_words", f"SELECT word, count(*) AS n FROM (SELECT unnest({_words_sql('text', 4)}) AS word FROM documents) GROUP BY 1")
def x1(spark, d):
    words = explode_values(B.table(spark, d, "documents"), [], ascii_words(F.col("text"), 4), "word")
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query("x2_ngrams", f"""
SELECT gram, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram
  FROM (SELECT {_words_sql('text', 3)} AS w FROM conversations)) GROUP BY 1""")
def x2(spark, d):
    tokens = B.table(spark, d, "conversations").select(ascii_words(F.col("text"), 3).alias("w"))
    grams = explode_values(tokens, [], F.concat(ngrams(F.col("w"), 2), ngrams(F.col("w"), 3)), "gram")
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("x16_excerpt", "SELECT doc_id, substring(text, 1, 500) AS excerpt FROM documents")
def x16(spark, d):
    return B.table(spark, d, "documents").select("doc_id", excerpt(F.col("text")).alias("excerpt"))


def keywords_sql(column):
    from convolens.functions.fixed import EVIDENCE_STOP_WORDS

    return (
        f"list_filter(list_transform(list_filter(regexp_extract_all(lower({column}), '\\S+'), "
        f"lambda w: w NOT IN ({B.quoted(EVIDENCE_STOP_WORDS)}) AND length(w) > 3), "
        "lambda w: regexp_replace(w, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')), lambda w: w <> '')"
    )


@query("f18_keywords", B.sql(f"""
SELECT conv_id, turn, pos, unnest(k) AS keyword, generate_subscripts(k, 1) - 1 AS at
FROM (SELECT conv_id, turn, pos, {keywords_sql('full_query')} AS k FROM cand)""", "cand"))
def f18(spark, d):
    return explode_positions(B.cand(spark, d), ["conv_id", "turn", "pos"], keywords(F.col("full_query")), "at", "keyword")
