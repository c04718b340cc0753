"""Topics, links, answer parsing, completion and cost queries."""

from pyspark.sql import functions as F

from convolens.functions import fixed, prompts, sections
from convolens.functions.text import strip
from convolens.operators import completion, followups, linking, topics
from convolens.operators.explode import explode_positions, explode_values
from convolens.plans import jobs

from . import bindings as B
from .normalise import _words_sql
from .registry import query


def _side(text, stop, phase, source, by):
    keep = f"list_filter({_words_sql(text, 4)}, lambda w: w NOT IN ({B.quoted(stop)}))[1:5]"
    return f"""SELECT {by} unnest(w) AS topic, {1 - phase} AS q, {phase} AS r, {phase} AS phase, qa_pos,
        generate_subscripts(w, 1) - 1 AS spot FROM (SELECT {by} qa_pos, {keep} AS w FROM {source})"""


def _terms(source, by=""):
    sides = [_side("query", fixed.QUERY_TOPIC_STOP_WORDS, 0, source, by), _side("response", fixed.RESPONSE_TOPIC_STOP_WORDS, 1, source, by)]
    return " UNION ALL ".join(sides)


def _counts(terms, by=""):
    return f"""SELECT {by} topic, sum(q)::BIGINT AS query_count, sum(r)::BIGINT AS response_count, min(row(phase, qa_pos, spot)) AS seen,
      sum(q)::DOUBLE * 0.6::DOUBLE + sum(r)::DOUBLE * 0.4::DOUBLE AS score FROM ({terms}) GROUP BY {by} topic"""


@query("a6_topic_scores", B.sql(f"""
SELECT row_number() OVER (ORDER BY score DESC, seen) AS rank, topic, query_count, response_count, round(score, 6) AS score
FROM ({_counts(_terms('qa'))}) ORDER BY rank LIMIT 8""", "qa"))
def a6(spark, d):
    return topics.topics(B.qa(spark, d)).withColumn("score", F.round("score", 6))


_TOP_ACTION = "SELECT action_label AS topic, 2 AS q, 2 AS r, 2 AS phase, 0 AS qa_pos, 0 AS spot FROM clusters WHERE cluster_id = 0"


@query("a7_action_bump", B.sql(f"""
SELECT row_number() OVER (ORDER BY score DESC, seen) AS rank, topic, query_count, response_count, round(score, 6) AS score
FROM ({_counts(_terms('qa') + ' UNION ALL ' + _TOP_ACTION)}) ORDER BY rank LIMIT 8""", "qa", "top_words", "clusters"))
def a7(spark, d):
    action = B.clusters(spark, d).where("cluster_id = 0").select("action_label")
    return topics.topics(B.qa(spark, d), actions=action).withColumn("score", F.round("score", 6))


@query("d3_term_union", B.sql(f"SELECT topic, query_count, response_count FROM ({_counts(_terms('qa'))})", "qa"))
def d3(spark, d):
    return topics.topic_counts(B.qa(spark, d)).select("topic", "query_count", "response_count")


_COMBINED = "lower(query) || ' ' || lower(substring(response, 1, 200))"


@query("a8_phrase_counts", B.sql(f"""
SELECT row_number() OVER (ORDER BY n DESC, seen) AS rank, phrase, n FROM (
  SELECT phrase, count(*) AS n, min(row(qa_pos, spot)) AS seen FROM (
    SELECT qa_pos, unnest(g) AS phrase, generate_subscripts(g, 1) - 1 AS spot FROM (
      SELECT qa_pos, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
        || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
      FROM (SELECT qa_pos, {_words_sql(_COMBINED, 3)} AS w FROM qa))) GROUP BY phrase)
ORDER BY rank LIMIT 5""", "qa"))
def a8(spark, d):
    return topics.phrases(B.qa(spark, d))


B.VIEWS["linked_all"] = """
  SELECT c.cluster_id, q.* FROM clusters c JOIN qa q
  ON contains(lower(q.query), c.action_label) OR len(list_filter(c.key_phrases, lambda p: contains(lower(q.query), p))) > 0
     OR contains(lower(q.response), c.action_label)"""
B.VIEWS["linked"] = """
  SELECT cluster_id, query, min(qa_pos) AS qa_pos, arg_max(response, qa_pos) AS response FROM linked_all GROUP BY 1, 2"""
_LINK = ("qa", "top_words", "clusters", "linked_all", "linked")


def _linked(spark, d):
    return linking.link_qas(B.clusters(spark, d), B.qa(spark, d))


@query("j1_link_qa", B.sql("SELECT cluster_id, qa_pos FROM linked_all", *_LINK))
def j1(spark, d):
    return linking.match_pairs(B.clusters(spark, d), B.qa(spark, d)).select("cluster_id", "qa_pos")


@query("j1_link_qa_anchored", B.sql("SELECT cluster_id, qa_pos FROM linked_all", *_LINK))
def j1_anchored(spark, d):
    return linking.match_pairs(B.clusters(spark, d), B.qa(spark, d), inline_rows=0).select("cluster_id", "qa_pos")


@query("d2_dedupe_qa", B.sql("SELECT cluster_id, qa_pos, md5(query) AS query, md5(response) AS response FROM linked", *_LINK))
def d2(spark, d):
    return _linked(spark, d).select("cluster_id", "qa_pos", F.md5("query").alias("query"), F.md5("response").alias("response"))


B.VIEWS["cluster_topics"] = f"""
  SELECT cluster_id, topic, score, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, seen) AS rank FROM (
    {_counts(_terms('linked', 'cluster_id,') + ' UNION ALL SELECT cluster_id, action_label, 2, 2, 2, 0, 0 FROM clusters', 'cluster_id,')})
  QUALIFY rank <= 8"""


@query("a6_topics_by_cluster", B.sql("SELECT cluster_id, rank, topic, round(score, 6) AS score FROM cluster_topics", *_LINK, "cluster_topics"))
def a6_grouped(spark, d):
    clusters = B.clusters(spark, d).select("cluster_id", "action_label")
    ranked = topics.topics(_linked(spark, d), by=["cluster_id"], actions=clusters)
    return ranked.select("cluster_id", "rank", "topic", F.round("score", 6).alias("score"))


_CONTEXT = "(SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY qa_pos) AS rank FROM linked)"


def _block_text(n, q, r, empty):
    return f"""SELECT c.cluster_id, coalesce(s.t, '{empty}') AS context FROM clusters c LEFT JOIN (
      SELECT cluster_id, string_agg('Q' || rank || ': ' || {q} || chr(10) || 'A' || rank || ': ' || {r} || chr(10) || chr(10), '' ORDER BY rank) AS t
      FROM {_CONTEXT} WHERE rank <= {n} GROUP BY 1) s USING (cluster_id)"""


def _cut(n):
    return f"CASE WHEN length(response) > {n} THEN substring(response, 1, {n}) || '...' ELSE response END"


_FOR_CONCEPTS = _block_text(3, "substring(query, 1, 60)", "substring(response, 1, 120) || '...'", "No QA data available")
_FOR_FUSION = _block_text(3, "query", _cut(150), "No QA data available")
_FOR_FOLLOWUPS = _block_text(2, "query", _cut(100), "No additional context")
_HASHED = "SELECT cluster_id, md5(context) AS context FROM ({})"


def _contexts(spark, d):
    context = linking.qa_context(_linked(spark, d))
    return B.clusters(spark, d).select("cluster_id", "action_label").join(context, "cluster_id", "left")


@query("w8_first_pairs", B.sql(f"SELECT cluster_id, rank, md5(query) AS query FROM {_CONTEXT} WHERE rank <= 3", *_LINK))
def w8(spark, d):
    at = linking.qa_context(_linked(spark, d)).select("cluster_id", F.posexplode("qas").alias("p", "qa"))
    return at.select("cluster_id", (F.col("p") + 1).alias("rank"), F.md5("qa.query").alias("query"))


@query("x11_concept_context", B.sql(_HASHED.format(_FOR_CONCEPTS), *_LINK))
def x11(spark, d):
    return _contexts(spark, d).select("cluster_id", F.md5(prompts.qa_for_concepts(F.col("qas"))).alias("context"))


@query("x12_fusion_context", B.sql(_HASHED.format(_FOR_FUSION), *_LINK))
def x12(spark, d):
    return _contexts(spark, d).select("cluster_id", F.md5(prompts.qa_for_fusion(F.col("qas"))).alias("context"))


@query("x13_followup_context", B.sql(_HASHED.format(_FOR_FOLLOWUPS), *_LINK))
def x13(spark, d):
    return _contexts(spark, d).select("cluster_id", F.md5(prompts.qa_for_followups(F.col("qas"))).alias("context"))


# --- answers ----------------------------------------------------------------------------------
_STRIPPED = r"regexp_replace(unnest(string_split({}, chr(10))), '^\s+|\s+$', '', 'g')"
B.VIEWS["concept_lines"] = f"""
  SELECT conv_id, turn, spot, line, CASE WHEN contains(upper(line), 'ROOT_CAUSE') OR contains(upper(line), 'CAUSAL') THEN 'causal'
         WHEN contains(upper(line), 'IMPACT') THEN 'impact' WHEN contains(upper(line), 'SCENARIO') OR contains(upper(line), 'PATTERN') THEN 'pattern' END AS header
  FROM (SELECT conv_id, turn, {_STRIPPED.format('concepts_answer')} AS line, generate_subscripts(string_split(concepts_answer, chr(10)), 1) AS spot FROM answers)"""
B.VIEWS["concepts"] = r"""
  SELECT conv_id, turn, category, regexp_replace(body, '[.,;:]+$', '') AS concept, row_number() OVER (PARTITION BY conv_id, turn, category ORDER BY spot) AS number
  FROM (SELECT *, regexp_replace(substring(line, 2), '^\s+|\s+$', '', 'g') AS body,
               last_value(header IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY spot) AS category FROM concept_lines)
  WHERE header IS NULL AND category IS NOT NULL AND (starts_with(line, '-') OR starts_with(line, '•')) AND length(body) > 2"""
_CONCEPTS = ("answers", "concept_lines", "concepts")


@query("w4_concept_sections", B.sql("SELECT conv_id, turn, category, count(*) AS n FROM concepts GROUP BY 1, 2, 3", *_CONCEPTS))
def w4(spark, d):
    found = explode_values(B.answers(spark, d), ["conv_id", "turn"], sections.concepts(F.col("concepts_answer")), "c")
    return found.groupBy("conv_id", "turn", F.col("c.category").alias("category")).agg(F.count("*").alias("n"))


@query("f20_concept_lines", B.sql(r"""
SELECT conv_id, turn, spot AS at, regexp_replace(body, '[.,;:]+$', '') AS concept FROM (
  SELECT conv_id, turn, spot, line, regexp_replace(substring(line, 2), '^\s+|\s+$', '', 'g') AS body FROM concept_lines)
WHERE (starts_with(line, '-') OR starts_with(line, '•')) AND length(body) > 2""", *_CONCEPTS))
def f20(spark, d):
    lines = B.answers(spark, d).select("conv_id", "turn", F.posexplode(F.split("concepts_answer", "\n")).alias("p", "line"))
    rows = lines.select("conv_id", "turn", (F.col("p") + 1).alias("at"), sections.bullet_text(strip(F.col("line"))).alias("concept"))
    return rows.where("concept is not null")


@query("m9_concepts", B.sql("SELECT conv_id, turn, category, number, concept FROM concepts", *_CONCEPTS))
def m9(spark, d):
    named = B.answers(spark, d).select("conv_id", "turn", F.explode(sections.concept_map(F.col("concepts_answer"))).alias("category", "items"))
    at = named.select("conv_id", "turn", "category", F.posexplode("items").alias("p", "concept"))
    return at.select("conv_id", "turn", "category", (F.col("p") + 1).alias("number"), "concept")


B.VIEWS["sections"] = r"""
  SELECT conv_id, turn, unnest(s) AS section, generate_subscripts(s, 1) AS sequence FROM (
    SELECT conv_id, turn, string_split_regex(questions_answer, 'QUESTION_\d+:\s*')[2:4] AS s FROM answers)"""
_OK = r"length(line) >= 10 AND contains(line, '?') AND len(regexp_extract_all(line, '\S+')) <= 75"
B.VIEWS["section_lines"] = f"""
  SELECT conv_id, turn, sequence, {_STRIPPED.format('section')} AS line, generate_subscripts(string_split(section, chr(10)), 1) AS spot FROM sections"""
B.VIEWS["questions"] = rf"""
  SELECT conv_id, turn, sequence, regexp_replace(arg_min(line, spot), '^\[.*?\]\s*', '') AS question,
         ['causal', 'impact', 'pattern'][sequence] AS category FROM section_lines WHERE {_OK} GROUP BY conv_id, turn, sequence"""
_QUESTIONS = ("answers", "sections", "section_lines", "questions")


@query("x14_sections", B.sql(r"SELECT conv_id, turn, sequence, md5(regexp_replace(section, '\s+$', '')) AS section FROM sections", *_QUESTIONS))
def x14(spark, d):
    at = explode_positions(B.answers(spark, d), ["conv_id", "turn"], sections.question_sections(F.col("questions_answer")), "p", "s")
    return at.select("conv_id", "turn", (F.col("p") + 1).alias("sequence"), F.md5(F.regexp_replace("s", r"\s+\z", "")).alias("section"))


@query("f19_followup_lines", B.sql(f"SELECT conv_id, turn, sequence, count(*) AS n FROM section_lines WHERE {_OK} GROUP BY 1, 2, 3", *_QUESTIONS))
def f19(spark, d):
    at = explode_positions(B.answers(spark, d), ["conv_id", "turn"], sections.question_sections(F.col("questions_answer")), "p", "s")
    lines = at.select("conv_id", "turn", (F.col("p") + 1).alias("sequence"), F.explode(F.split("s", "\n")).alias("line"))
    return lines.where(sections.is_followup_line(strip(F.col("line")))).groupBy("conv_id", "turn", "sequence").agg(F.count("*").alias("n"))


@query("w5_first_question", B.sql(f"SELECT conv_id, turn, sequence, arg_min(line, spot) AS line FROM section_lines WHERE {_OK} GROUP BY 1, 2, 3", *_QUESTIONS))
def w5(spark, d):
    at = explode_positions(B.answers(spark, d), ["conv_id", "turn"], sections.question_sections(F.col("questions_answer")), "p", "s")
    return at.select("conv_id", "turn", (F.col("p") + 1).alias("sequence"), sections.first_question(F.col("s")).alias("line")).where("line is not null")


@query("x15_strip_tag", B.sql(r"SELECT conv_id, turn, regexp_replace('[' || role || '] ' || text, '^\[.*?\]\s*', '') AS text FROM conversations"))
def x15(spark, d):
    tagged = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", sections.strip_tag(tagged).alias("text"))


@query("m11_followups", B.sql("SELECT conv_id, turn, sequence, question, category FROM questions", *_QUESTIONS))
def m11(spark, d):
    found = explode_values(B.answers(spark, d), ["conv_id", "turn"], sections.followups(F.col("questions_answer")), "f")
    return found.select("conv_id", "turn", "f.*")


def _enriched(spark, d):
    """One row per conversation turn, as a cluster with its follow-ups and topics."""
    rows = B.answers(spark, d).select(
        "conv_id", F.col("turn").alias("cluster_id"), sections.followups(F.col("questions_answer")).alias("followups"))
    words = B.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("cluster_id"), "role", F.split("text", " ").alias("topics"))
    return rows.join(words, ["conv_id", "cluster_id"]).select(
        (F.col("conv_id") * F.lit(4294967296) + F.col("cluster_id")).alias("cluster_id"),
        F.when(F.col("role") != "system", F.col("role")).alias("action_label"), "topics", "followups")


@query("s7_followup_rows", B.sql("""
SELECT q.conv_id * 4294967296 + q.turn AS cluster_id, CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS action_label,
       row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY sequence) AS question_number, question, category,
       array_to_string(string_split(text, ' ')[1:3], ', ') AS related_topics
FROM questions q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn = q.turn""", *_QUESTIONS))
def s7(spark, d):
    return followups.followup_rows(_enriched(spark, d))


@query("w9_question_number", B.sql("""
SELECT conv_id * 4294967296 + turn AS cluster_id, count(*) AS questions, max(number) AS last FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sequence) AS number FROM questions) GROUP BY 1""", *_QUESTIONS))
def w9(spark, d):
    rows = followups.followup_rows(_enriched(spark, d))
    return rows.groupBy("cluster_id").agg(F.count("*").alias("questions"), F.max("question_number").alias("last"))


# --- completion ---------------------------------------------------------------------------------
def echo_client():
    """A stand-in for a model: the prompt backwards, no answer for every third length, an error for every fifth."""
    def client(prompt, system_prompt=None, **options):
        if len(prompt) % 5 == 0:
            raise ValueError("no answer")
        return None if len(prompt) % 3 == 0 else prompt[::-1]
    return client


@query("m3_complete", "SELECT conv_id, turn, md5(CASE WHEN length(text) % 5 > 0 AND length(text) % 3 > 0 THEN list_reduce(string_split(text, ''), lambda x, y: y || x) END) AS response FROM conversations")
def m3(spark, d):
    rows = completion.complete(B.table(spark, d, "conversations"), "text", echo_client)
    return rows.select("conv_id", "turn", F.md5("response").alias("response"))


def counting_client():
    """JSON with the prompt's length; every fourth answer lacks the field, every seventh is out of range."""
    def client(prompt, system_prompt=None, **options):
        n = len(prompt)
        return '{"other": 1}' if n % 4 == 0 else f'{{"confidence": {2.0 if n % 7 == 0 else 0.5}, "length": {n}}}'
    return client


_STRUCTURED = """SELECT conv_id, turn, CASE WHEN length(text) % 4 > 0 AND length(text) % 7 > 0 THEN length(text) END AS length FROM conversations"""


@query("m4_structured", _STRUCTURED)
def m4(spark, d):
    from convolens.functions.rules import confidence_in_range

    rows = completion.complete_structured(
        B.table(spark, d, "conversations"), "text", counting_client, "confidence double, length bigint",
        lambda r: confidence_in_range(r["confidence"]))
    return rows.select("conv_id", "turn", "result.length")


@query("m5_batch", f"SELECT count(*) AS asked, count(length) AS answered FROM ({_STRUCTURED})")
def m5(spark, d):
    return m4(spark, d).agg(F.count("*").alias("asked"), F.count("length").alias("answered"))


def _rate(i):
    return "CASE model " + " ".join(f"WHEN '{m}' THEN {p[i]}::DOUBLE" for m, p in fixed.PRICES.items()) + " ELSE 0.0 END"


@query("j6_cost", B.sql(f"""SELECT model, count(*) AS calls, round(sum(input_tokens / 1000000.0::DOUBLE * {_rate(0)} + output_tokens / 1000000.0::DOUBLE * {_rate(1)}), 6) AS cost
FROM usage GROUP BY model""", "usage"))
def j6(spark, d):
    return completion.cost_by_model(B.usage(spark, d)).withColumn("cost", F.round("cost", 6))


def _prompted(name, template, context, make, **slots):
    first = lambda n: f"(SELECT coalesce(string_agg(topic, ', ' ORDER BY rank), '') FROM cluster_topics t WHERE t.cluster_id = c.cluster_id AND rank <= {n})"
    filled = B.sql_fill(template, action="c.action_label", seed="c.action_label", fused="c.action_label", qas="x.context",
                        **{slot: value if isinstance(value, str) else first(value) for slot, value in slots.items()})

    @query(name, B.sql(f"SELECT c.cluster_id, md5({filled}) AS prompt FROM clusters c JOIN ({context}) x USING (cluster_id)", *_LINK, "cluster_topics"))
    def run(spark, d):
        rows = _contexts(spark, d).join(jobs.cluster_topics(B.clusters(spark, d), _linked(spark, d)), "cluster_id", "left")
        return rows.select("cluster_id", F.md5(make(rows)).alias("prompt"))


_prompted("x17_prompt_seed", prompts.SEED_PROMPT, _FOR_CONCEPTS, lambda r: prompts.expand_seed(r["action_label"]))
_prompted("x18_prompt_concepts", prompts.CONCEPT_PROMPT, _FOR_CONCEPTS,
          lambda r: prompts.select_concepts(r["action_label"], r["topics"], r["qas"]), topics=5)
_prompted("x19_prompt_fusion", prompts.FUSION_PROMPT, _FOR_FUSION,
          lambda r: prompts.fuse(r["action_label"], r["topics"], F.create_map(
              F.lit("causal"), r["topics"], F.lit("impact"), F.array(r["action_label"]), F.lit("pattern"), F.array().cast("array<string>")), r["qas"]),
          topics=4, causal=2, impact="c.action_label", pattern="''")
_prompted("x20_prompt_followups", prompts.FOLLOWUP_PROMPT, _FOR_FOLLOWUPS,
          lambda r: prompts.ask_followups(r["action_label"], r["topics"], r["action_label"], r["qas"]), topics=5)


_JUDGE = B.sql_fill(prompts.JUDGE_PROMPT, query="query", event="'general'", context="substring(transcript, 1, 500)")


@query("x21_prompt_judge", B.sql(f"SELECT doc_id, md5({_JUDGE}) AS prompt FROM pairs", "raw", "split_docs", "rendered", "pairs"))
def x21(spark, d):
    return B.pairs(spark, d).select("doc_id", F.md5(prompts.judge(F.col("query"), F.lit("general"), F.col("transcript"))).alias("prompt"))


def section_client():
    """Answers in the form each prompt asks for, made of the prompt's own words."""
    def client(prompt, system_prompt=None, **options):
        first = prompt.split("Cluster: ", 1)[1].split("\n", 1)[0]
        if "QUESTION_1:" in prompt:
            return f"QUESTION_1:\nWhy does {first} come up?\nQUESTION_2:\nHow often is it {first}?"
        return f"ROOT_CAUSES:\n- {first} early\nIMPACTS:\n- {first} late" if "ROOT_CAUSES:" in prompt else f"CAUSAL_CHAIN:\n- {first}"
    return client


@query("m10_fuse", B.sql("SELECT cluster_id, 'CAUSAL_CHAIN:' || chr(10) || '- ' || action_label AS fused FROM clusters", "top_words", "clusters"))
def m10(spark, d):
    rows = jobs.run_followups(B.clusters(spark, d), B.qa(spark, d), section_client)
    return rows.select("cluster_id", "fused")


@query("m15_followup_job", B.sql("""
SELECT cluster_id, 'Why does ' || action_label || ' come up?' AS question, 'causal' AS category, 1 AS sequence FROM clusters
UNION ALL SELECT cluster_id, 'How often is it ' || action_label || '?', 'impact', 2 FROM clusters""", "top_words", "clusters"))
def m15(spark, d):
    rows = jobs.run_followups(B.clusters(spark, d), B.qa(spark, d), section_client)
    return rows.select("cluster_id", F.inline("followups"))
