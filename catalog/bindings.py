"""Operator inputs derived from the shared tables: a DataFrame and the matching SQL for each.

``sql(select, *names)`` puts the named views in front of a select.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from convolens.functions.text import ascii_words
from convolens.functions.turns import plain_text_episode, user_or_system
from convolens.operators.explode import explode_values
from convolens.operators.profile import centroids
from convolens.scale import cut, keep, spread

VIEWS: dict[str, str] = {}

STOP_WORDS = ["the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as",
              "with", "his", "they", "at", "be", "this", "from", "or", "by", "de", "la", "le"]
LEXICON = [("that", 0.8), ("with", 0.4), ("from", -0.6), ("this", 0.1), ("que", 0.5), ("les", -0.9),
           ("ist", 0.7), ("und", -0.2), ("para", 0.3), ("der", -0.4), ("une", 0.25), ("which", -0.75)]
OPENERS = ["Why", "How", "However", "What causes", "What date", "Who said", "Compare", ""]
DOMAINS = ["Hotel", "Billing Support", "Retention Desk", "GDPR Requests", "Complaint Handling", "Telecom", "", None]


def sql(select: str, *names: str) -> str:
    if not names:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names) + "\n" + select


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_case(key: str, values: list) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE {key} {arms} END"


def sql_fill(template: str, **values: str) -> str:
    """SQL text of a prompt template with an expression for each slot."""
    text = "'" + template.replace("'", "''") + "'"
    for name, expression in values.items():
        text = text.replace("{" + name + "}", f"' || {expression} || '")
    return f"({text})"


def case(key, values: list):
    chain = None
    for i, v in enumerate(values):
        value = F.lit(v).cast("string")
        chain = F.when(key == i, value) if chain is None else chain.when(key == i, value)
    return chain


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- turns: conversations with 1-based numbers and speaker names --------------------------
VIEWS["turns"] = """
  SELECT conv_id, turn, turn + 1 AS number, text,
         CASE role WHEN 'user' THEN 'Customer' WHEN 'assistant' THEN 'Agent' ELSE 'System' END AS speaker
  FROM conversations"""


def turns(spark, folder):
    role = F.col("role")
    speaker = F.when(role == "user", "Customer").when(role == "assistant", "Agent").otherwise("System")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("number"), "text", speaker.alias("speaker")
    )


# --- qa: a user turn and the assistant turn right after it ---------------------------------
VIEWS["qa"] = """
  SELECT u.conv_id * 4294967296 + u.turn AS qa_pos, u.conv_id, u.text AS query, a.text AS response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'"""


def qa(spark, folder):
    rows = table(spark, folder, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    answered = rows.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        (F.col("conv_id") * F.lit(4294967296) + F.col("turn")).alias("qa_pos"), "conv_id", "query", "response"
    )


# --- cand: every line of every turn as a candidate query -----------------------------------
VIEWS["cand"] = f"""
  SELECT conv_id, turn, pos,
         {sql_case('(turn + pos) % 8', OPENERS)} || ' ' || line || '?' AS full_query,
         CASE WHEN (conv_id + pos) % 11 = 0 THEN '' ELSE {sql_case('(turn + pos) % 8', OPENERS)} || ' ' || line || '?' END AS query,
         {sql_case('(conv_id + turn) % 4', ['The Agent', '', 'late refund', 'customer'])} AS causal_trigger,
         {sql_case('(conv_id + pos) % 4', ['churn', 'RESULT', 'outcome', None])} AS causal_outcome,
         1 + pos % 6 AS complexity_level
  FROM (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos
        FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations))"""


def cand(spark, folder):
    lines = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    opener = case((F.col("turn") + F.col("pos")) % 8, OPENERS)
    full = F.concat(opener, F.lit(" "), F.col("line"), F.lit("?"))
    return lines.select(
        "conv_id", "turn", "pos", full.alias("full_query"),
        F.when((F.col("conv_id") + F.col("pos")) % 11 == 0, "").otherwise(full).alias("query"),
        case((F.col("conv_id") + F.col("turn")) % 4, ["The Agent", "", "late refund", "customer"]).alias("causal_trigger"),
        case((F.col("conv_id") + F.col("pos")) % 4, ["churn", "RESULT", "outcome", None]).alias("causal_outcome"),
        (1 + F.col("pos") % 6).alias("complexity_level"),
    )


# --- raw: documents as plain-text transcripts, one per row ---------------------------------
VIEWS["raw"] = f"""
  SELECT doc_id, source, lang,
         CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'D' || doc_id END AS transcript_id,
         CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS id,
         {sql_case('doc_id % 8', DOMAINS)} AS domain,
         array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
           CASE (i - 1) % 4 WHEN 0 THEN 'Customer: ' WHEN 1 THEN 'Agent: ' WHEN 2 THEN '  ' ELSE 'Support: ' END || x),
           chr(10)) AS conversation
  FROM documents"""


def raw(spark, folder):
    doc = F.col("doc_id")

    def labelled(line, i):
        k = i % 4
        return F.concat(
            F.when(k == 0, "Customer: ").when(k == 1, "Agent: ").when(k == 2, "  ").otherwise("Support: "), line
        )

    return spread(table(spark, folder, "documents").select("doc_id", "source", "lang", "text")).select(
        "doc_id", "source", "lang",
        F.when(doc % 3 != 0, F.concat(F.lit("D"), doc.cast("string"))).alias("transcript_id"),
        F.when(doc % 5 != 0, F.col("source")).alias("id"),
        case(doc % 8, DOMAINS).alias("domain"),
        F.array_join(F.transform(F.split("text", "\n"), labelled), "\n").alias("conversation"),
    )


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SPLIT_TURNS = (
    "string_split(regexp_replace(array_to_string(list_filter(list_transform(string_split(conversation, chr(10)), "
    "lambda x: " + _TRIM.format("x") + "), lambda x: x <> ''), chr(10)), "
    r"'\n(Agent|Customer|Representative|User|Caller|Support):', concat(chr(1), '\1:'), 'g'), chr(1))"
)
VIEWS["split_docs"] = f"""
  SELECT doc_id, source, domain, transcript_id, id, conversation,
         list_filter(list_transform({SPLIT_TURNS}, lambda x: replace(x, chr(10), ' ')), lambda x: x <> '') AS ts
  FROM raw"""
VIEWS["rendered"] = """
  SELECT doc_id, source, domain, transcript_id, id,
         CASE WHEN len(ts) > 0
              THEN array_to_string(list_transform(ts, lambda x, i: 'Turn ' || i || ': ' || x), chr(10))
              ELSE 'Turn 1: Unknown: ' || conversation END AS text_with_turns,
         CASE WHEN len(ts) > 0 THEN array_to_string(ts, chr(10)) ELSE conversation END AS text,
         CASE WHEN len(ts) > 0 THEN len(ts) ELSE 1 END AS turn_count
  FROM split_docs"""


def rendered(spark, folder):
    rows = raw(spark, folder).withColumn("e", plain_text_episode(F.col("conversation")))
    return rows.select(
        "doc_id", "source", "domain", "transcript_id", "id",
        "e.text_with_turns", "e.text", F.col("e.turn_count").cast("bigint").alias("turn_count"),
    )


VIEWS["doc_turns"] = r"""
  SELECT doc_id, number, speaker, text FROM (
    SELECT doc_id,
           try_cast(regexp_extract(line, '^Turn\s*([+-]?\d+)\s*:', 1) AS BIGINT) AS number,
           regexp_replace(regexp_extract(line, '^[^:]*:([^:]*):', 1), '^\s+|\s+$', '', 'g') AS speaker,
           regexp_replace(regexp_extract(line, '(?s)^[^:]*:[^:]*:(.*)$', 1), '^\s+|\s+$', '', 'g') AS text,
           line
    FROM (SELECT doc_id, regexp_replace(unnest(string_split(text_with_turns, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM rendered))
  WHERE starts_with(line, 'Turn ') AND regexp_matches(line, '^[^:]*:[^:]*:') AND number IS NOT NULL"""


# The same turns as a list in the row of their transcript, which needs no unnesting and no join back.
TURN_LIST = r"""list_filter(list_transform(list_filter(list_transform(string_split({}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
    lambda x: starts_with(x, 'Turn ') AND regexp_matches(x, '^[^:]*:[^:]*:')), lambda x: struct_pack(
      number := try_cast(regexp_extract(x, '^Turn\s*([+-]?\d+)\s*:', 1) AS BIGINT),
      speaker := lower(regexp_extract(x, '^[^:]*:([^:]*):', 1)),
      words := lower(regexp_replace(regexp_extract(x, '(?s)^[^:]*:[^:]*:(.*)$', 1), '^\s+|\s+$', '', 'g')))),
    lambda t: t.number IS NOT NULL)"""


# --- pairs: every document with one benchmark passage as its query --------------------------
VIEWS["pairs"] = """
  SELECT r.doc_id, 'Why ' || b.text AS query, r.text_with_turns AS transcript, r.domain
  FROM rendered r JOIN benchmark b ON b.item_id = r.doc_id % (SELECT count(*) FROM benchmark)"""


def pairs(spark, folder):
    items = table(spark, folder, "benchmark")
    size = items.agg(F.count("*")).scalar()
    docs = rendered(spark, folder).withColumn("item_id", F.col("doc_id") % size)
    return docs.join(items.select("item_id", F.col("text").alias("item")), "item_id").select(
        "doc_id", F.concat(F.lit("Why "), F.col("item")).alias("query"),
        F.col("text_with_turns").alias("transcript"), "domain",
    )


# --- utter: documents with embeddings; the label is the cluster -----------------------------
VIEWS["utter"] = """
  SELECT e.label AS cluster, d.doc_id AS id, d.text, e.embedding,
         CASE WHEN lower(CASE d.doc_id % 4 WHEN 0 THEN 'Customer' WHEN 1 THEN 'agent' WHEN 2 THEN 'CLIENT' END)
              IN ('user', 'customer', 'client') THEN 'user' ELSE 'system' END AS speaker
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id"""


def utter(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    speaker = case(F.col("doc_id") % 4, ["Customer", "agent", "CLIENT", None])
    return docs.join(vectors, "doc_id").select(
        F.col("label").alias("cluster"), F.col("doc_id").alias("id"), "text", "embedding",
        user_or_system(speaker).alias("speaker"),
    )


def utter_once(spark, folder):
    """The same as a table, for queries that read it several times: the texts are joined and moved once."""
    return keep(utter(spark, folder))


# --- ontology: the mean vector of every label ----------------------------------------------
VIEWS["centers"] = """
  SELECT cluster, list(m ORDER BY spot) AS centroid FROM (
    SELECT cluster, spot, avg(x) AS m FROM (
      SELECT cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS spot FROM utter)
    GROUP BY cluster, spot) GROUP BY cluster"""
VIEWS["ontology"] = "SELECT cluster AS pos, 'label_' || cluster AS label, centroid AS vector FROM centers"


def ontology(spark, folder, utterances=None):
    labels = centroids(utter(spark, folder) if utterances is None else utterances).select(
        F.col("cluster").alias("pos"),
        F.concat(F.lit("label_"), F.col("cluster").cast("string")).alias("label"),
        F.col("centroid").alias("vector"),
    )
    return cut(labels)


VIEWS["lexicon"] = "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {p}::DOUBLE)" for w, p in LEXICON) + ") t(word, polarity)"


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, polarity double")


# --- clusters: eight profiles from the most frequent words of the documents ------------------
VIEWS["top_words"] = r"""
  SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (
    SELECT word, count(*) AS n FROM (
      SELECT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM documents)
    WHERE regexp_full_match(word, '[a-z]{4,}') GROUP BY word)
  QUALIFY rank <= 24"""
VIEWS["clusters"] = """
  SELECT (rank - 1) // 3 AS cluster_id, min(CASE WHEN (rank - 1) % 3 = 0 THEN word END) AS action_label,
         list(word ORDER BY rank) FILTER (WHERE (rank - 1) % 3 > 0) AS key_phrases
  FROM top_words GROUP BY 1"""


def clusters(spark, folder):
    words = explode_values(table(spark, folder, "documents"), [], ascii_words(F.col("text"), 4), "word")
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(24)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "word"))).alias("w"))
    rows = ranked.select(F.posexplode("w").alias("at", "w")).select(F.floor(F.col("at") / 3).alias("cluster_id"), "at", "w.word")
    return rows.groupBy("cluster_id").agg(
        F.min(F.when(F.col("at") % 3 == 0, F.col("word"))).alias("action_label"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("at") % 3 > 0, F.struct("at", "word")))),
                    lambda x: x["word"]).alias("key_phrases"),
    )


# --- answers: completion texts built from the turns ------------------------------------------
VIEWS["answers"] = """
  SELECT conv_id, turn,
         'Intro line' || chr(10) || 'ROOT_CAUSES:' || chr(10) || '- ' || replace(text, chr(10), chr(10) || '- ') || chr(10)
         || chr(10) || 'IMPACTS:' || chr(10) || '• ' || replace(text, '. ', '.' || chr(10) || '• ') || chr(10)
         || 'Patterns' || chr(10) || '- ' || text AS concepts_answer,
         'QUESTION_1:' || chr(10) || '[tag] ' || replace(text, '. ', '?' || chr(10)) || chr(10) || chr(10)
         || 'QUESTION_2:' || chr(10) || text || chr(10)
         || 'QUESTION_3: ' || replace(text, chr(10), '?' || chr(10)) AS questions_answer
  FROM conversations"""


def answers(spark, folder):
    text = F.col("text")
    swap = lambda old, new: F.replace(text, F.lit(old), F.lit(new))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.concat(F.lit("Intro line\nROOT_CAUSES:\n- "), swap("\n", "\n- "), F.lit("\n\nIMPACTS:\n• "),
                 swap(". ", ".\n• "), F.lit("\nPatterns\n- "), text).alias("concepts_answer"),
        F.concat(F.lit("QUESTION_1:\n[tag] "), swap(". ", "?\n"), F.lit("\n\nQUESTION_2:\n"), text,
                 F.lit("\nQUESTION_3: "), swap("\n", "?\n")).alias("questions_answer"),
    )


# --- scores and usage -------------------------------------------------------------------------
VIEWS["scores"] = """
  SELECT doc_id, 1 + doc_id % 5 AS causal_depth, 1 + (doc_id + quality) % 5 AS clarity,
         1 + (doc_id + toxic) % 5 AS business_value FROM labels"""


def scores(spark, folder):
    doc = F.col("doc_id")
    return table(spark, folder, "labels").select(
        "doc_id", (1 + doc % 5).alias("causal_depth"), (1 + (doc + F.col("quality")) % 5).alias("clarity"),
        (1 + (doc + F.col("toxic")) % 5).alias("business_value"),
    )


MODELS = {"view": "gpt-4o", "click": "gpt-4o-mini", "error": "claude-3-haiku-20240307", "signup": "gemini/gemini-1.5-flash"}
VIEWS["usage"] = (
    "SELECT CASE event_type " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in MODELS.items())
    + " ELSE 'unknown' END AS model, value * 100 AS input_tokens, value * 10 AS output_tokens FROM events"
)


def usage(spark, folder):
    event, model = F.col("event_type"), None
    for e, m in MODELS.items():
        model = F.when(event == e, m) if model is None else model.when(event == e, m)
    return table(spark, folder, "events").select(
        model.otherwise("unknown").alias("model"),
        (F.col("value") * 100).alias("input_tokens"), (F.col("value") * 10).alias("output_tokens"),
    )
