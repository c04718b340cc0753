"""Reader queries: raw rows and JSON texts built from the shared tables go through the readers' own code."""

import pyarrow as pa
from pyspark.sql import Window, functions as F

from convolens.scale import shared_path
from convolens.sources import json_transcripts as J, sinks
from convolens.sources.csv_transcripts import load_transcripts, transcripts_of_rows, with_episode
from convolens.sources.qa_pairs import load_qa_pairs

from . import bindings as B
from .registry import query

_RENDERED = ("raw", "split_docs", "rendered")


# --- rows of a CSV file ---------------------------------------------------------------------

def _loaded(spark, d):
    """Documents as CSV rows; every seventh has a cell too many."""
    rows = B.raw(spark, d).withColumn("row_index", F.col("doc_id"))
    names = ("transcript_id", "id", "conversation", "domain")
    return transcripts_of_rows(rows, {n: F.col(n) for n in names}, F.col("doc_id") % 7 == 0)


@query("p18_episodes", B.sql("""
SELECT coalesce(transcript_id, id, 'T_' || lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INTEGER, '0')) AS id, md5(text) AS text,
       md5(text_with_turns) AS text_with_turns, coalesce(domain, 'General') AS domain, turn_count, doc_id AS row_index, 'str' AS raw_format
FROM rendered JOIN (SELECT doc_id FROM raw WHERE conversation <> '' AND doc_id % 7 <> 0) USING (doc_id)""", *_RENDERED))
def p18(spark, d):
    return _loaded(spark, d).episodes.select(
        "id", F.md5("text").alias("text"), F.md5("text_with_turns").alias("text_with_turns"), "domain",
        F.col("turn_count").cast("bigint").alias("turn_count"), "metadata.row_index", "metadata.raw_format")


@query("s4_rejected_rows", "SELECT doc_id AS row_index, 'more cells than columns' AS error FROM documents WHERE doc_id % 7 = 0")
def s4(spark, d):
    return _loaded(spark, d).rejected.select("row_index", "error")


@query("a12_load_stats", B.sql("""
SELECT count(*) FILTER (WHERE doc_id % 7 <> 0 AND conversation <> '') AS total_loaded, count(*) FILTER (WHERE doc_id % 7 = 0) AS parse_errors FROM raw""", "raw"))
def a12(spark, d):
    return _loaded(spark, d).stats()


@query("f3_empty_conversation", B.sql("SELECT doc_id FROM raw WHERE coalesce(domain, '') <> ''", "raw"))
def f3(spark, d):
    rows = B.raw(spark, d).select(F.col("doc_id").alias("row_index"), F.col("domain").alias("Text"))
    return transcripts_of_rows(rows, {"Text": F.col("Text")}).episodes.select(F.col("metadata.row_index").alias("doc_id"))


@query("p8_row_metadata", "SELECT doc_id AS row_index, CASE WHEN doc_id % 2 = 0 THEN 'list' ELSE 'str' END AS raw_format FROM documents")
def p8(spark, d):
    listed = F.to_json(F.split("text", "\n"))
    rows = B.table(spark, d, "documents").select(
        F.col("doc_id").alias("row_index"),
        F.when(F.col("doc_id") % 2 == 0, listed).otherwise(F.concat(F.lit("Agent: "), "text")).alias("transcript"))
    return transcripts_of_rows(rows, {"transcript": F.col("transcript")}).episodes.select("metadata.row_index", "metadata.raw_format")


@query("p4_python_literal", "SELECT conv_id, turn, 1 AS number, role AS speaker, text FROM conversations")
def p4(spark, d):
    """Cells that only Python reads, for the null in them."""
    escaped = F.col("text")
    for plain, written in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    cell = F.concat(F.lit("[{'speaker': '"), F.col("role"), F.lit("', 'text': '"), escaped, F.lit("', 'more': None}]"))
    rows = B.table(spark, d, "conversations").select("conv_id", "turn", cell.alias("conversation"))
    return with_episode(rows).select("conv_id", "turn", F.explode("turns").alias("t")).select("conv_id", "turn", "t.*")


# --- JSON documents -------------------------------------------------------------------------

def _turns(spark, d):
    """Every turn as a JSON object, under changing keys."""
    turn, text, role = F.col("turn"), F.col("text"), F.col("role")
    fields = F.struct(
        F.when(turn % 3 == 0, text).alias("text"), F.when(turn % 3 == 1, text).alias("Content"),
        F.when(turn % 3 == 2, text).alias("utterance"), F.when(turn % 2 == 0, role).alias("role"),
        F.when(turn % 2 == 1, role).alias("speaker"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.to_json(fields).alias("turn_json"))


_SPEAKER = "CASE WHEN lower(role) IN ('user', 'customer', 'client') THEN 'user' ELSE 'system' END"


@query("p9_turn_text", "SELECT conv_id, turn, nullif(text, '') AS text FROM conversations")
def p9(spark, d):
    return _turns(spark, d).select("conv_id", "turn", J.turn_text(F.parse_json("turn_json")).alias("text"))


@query("p10_turn_speaker", f"SELECT conv_id, turn, {_SPEAKER} AS speaker FROM conversations")
def p10(spark, d):
    return _turns(spark, d).select("conv_id", "turn", J.turn_speaker(F.parse_json("turn_json")).alias("speaker"))


@query("s2_json_documents", f"""
SELECT conv_id AS source, CASE WHEN conv_id % 4 < 2 THEN '0' ELSE 'c' || conv_id END AS conv_id, pos, speaker, text FROM (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, {_SPEAKER} AS speaker, text FROM conversations)
WHERE text <> ''""")
def s2(spark, d):
    """A document per conversation: a list of turns, Transcript, dialogs, or a list of dialogues."""
    rows = _turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "turn_json"))).alias("turns"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("turns", lambda t: t["turn_json"]), ","), F.lit("]"))
    name, shape = F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("conv_id") % 4
    document = (
        F.when(shape == 0, listed).when(shape == 1, F.concat(F.lit('{"n": 1, "Transcript": '), listed, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"dialogs": {"'), name, F.lit('": '), listed, F.lit("}}")))
        .otherwise(F.concat(F.lit('[{"transcript_id": "'), name, F.lit('", "turns": '), listed, F.lit("}]"))))
    loaded = J.utterances_of_documents(rows.select(F.col("conv_id").alias("source"), document.alias("value")))
    return loaded.utterances.drop("dialog_pos")


@query("s2_json_rejected", "SELECT conv_id AS source, turn AS dialog_pos, 'no valid JSON' AS error FROM conversations WHERE turn % 5 = 4")
def s2_rejected(spark, d):
    lines = _turns(spark, d).select(
        F.col("conv_id").alias("source"), F.col("turn").alias("dialog_pos"),
        F.when(F.col("turn") % 5 == 4, F.concat(F.lit("{"), "turn_json"))
        .otherwise(F.concat(F.lit('{"turns": ['), "turn_json", F.lit("]}"))).alias("value"))
    return J.utterances_of_lines(lines).rejected


@query("s2_json_strange", """
SELECT conv_id AS source, turn AS dialog_pos, CASE turn % 3 WHEN 0 THEN 'no turns' WHEN 1 THEN 'no turn' ELSE 'no object' END AS error FROM conversations""")
def s2_strange(spark, d):
    """Lines of unknown shapes: a turn alone, a list of numbers as turns, a list."""
    shape, turn = F.col("turn") % 3, F.col("turn_json")
    lines = _turns(spark, d).select(
        F.col("conv_id").alias("source"), F.col("turn").alias("dialog_pos"),
        F.when(shape == 0, turn).when(shape == 1, F.lit('{"turns": [7]}')).otherwise(F.concat(F.lit("["), turn, F.lit("]"))).alias("value"))
    return J.utterances_of_lines(lines).rejected


@query("p12_flatten", B.sql("SELECT doc_id AS conv_id, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS pos FROM split_docs", "raw", "split_docs"))
def p12(spark, d):
    """Dialogues given as one string."""
    dialogs = F.create_map(F.col("doc_id").cast("string"), F.col("conversation"))
    documents = B.raw(spark, d).select(
        F.col("doc_id").alias("source"), F.to_json(F.struct(dialogs.alias("dialogs"))).alias("value"))
    return J.utterances_of_documents(documents).utterances.select(F.col("conv_id").cast("bigint").alias("conv_id"), "text", "pos")


@query("f1_domain_filter", B.sql("SELECT doc_id FROM raw WHERE lower(domain) = 'hotel'", "raw"))
def f1(spark, d):
    entry = F.struct(F.col("doc_id").cast("string").alias("transcript_id"), "domain", F.lit("Agent: hello").alias("conversation"))
    lines = B.raw(spark, d).select(F.col("doc_id").alias("source"), F.col("doc_id").alias("dialog_pos"), F.to_json(entry).alias("value"))
    return J.utterances_of_lines(lines, domain="HOTEL").utterances.select(F.col("source").alias("doc_id"))


@query("f2_empty_drop", """
SELECT conv_id, count(*) AS lines FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE line <> '' GROUP BY 1""")
def f2(spark, d):
    """Lines as turns, the empty ones among them."""
    turns = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("text")))
    documents = B.table(spark, d, "conversations").select(
        F.col("conv_id").alias("source"), F.to_json(F.struct(turns.alias("Transcript"))).alias("value"))
    found = J.utterances_of_documents(documents).utterances
    return found.groupBy(F.col("source").alias("conv_id")).agg(F.count("*").alias("lines"))


# --- scans of files -------------------------------------------------------------------------

def _as_list(batches):
    """The lines of a task as one JSON list."""
    first = True
    for batch in batches:
        values = [("," if i or not first else "[") + value for i, value in enumerate(batch.column(0).to_pylist())]
        first = first and not values
        yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string())})
    yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})


def _written_lists(spark, values):
    """A folder of files, each one JSON list."""
    path = shared_path(spark, "lists")
    values.select(values.columns[0]).mapInArrow(_as_list, "value string").write.text(path)
    return path


@query("s1_csv_scan", """
SELECT conv_id || ':' || turn AS id, role AS domain, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text
FROM conversations WHERE text <> ''""")
def s1_scan(spark, d):
    """Turns written as CSV files, line breaks in the cells, and loaded again."""
    path = shared_path(spark, "csv")
    rows = B.table(spark, d, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("transcript_id"), F.col("text").alias("conversation"), F.col("role").alias("domain"))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return load_transcripts(spark, path).episodes.select("id", "domain", "text")


@query("s3_qa_scan", """
SELECT text AS query, role AS response, CASE WHEN turn % 5 <> 4 THEN turn / 8.0::DOUBLE END AS confidence, NULL::VARCHAR AS error FROM conversations WHERE turn % 7 <> 6
UNION ALL SELECT NULL, NULL, NULL, 'no object' FROM conversations WHERE turn % 7 = 6""")
def s3_scan(spark, d):
    """Lists of pairs; some confidences are words, and some items are numbers."""
    turn = F.col("turn")
    pair = F.to_json(F.struct(F.col("text").alias("query"), F.col("role").alias("response"), (turn / 8).alias("confidence")))
    odd = F.to_json(F.struct(F.col("text").alias("query"), F.col("role").alias("response"), F.lit("high").alias("confidence")))
    values = B.table(spark, d, "conversations").select(F.when(turn % 7 == 6, turn.cast("string")).when(turn % 5 == 4, odd).otherwise(pair).alias("value"))
    loaded = load_qa_pairs(spark, _written_lists(spark, values))
    pairs = loaded.pairs.select("query", "response", "confidence", F.lit(None).cast("string").alias("error"))
    return pairs.unionByName(loaded.rejected.select("error"), allowMissingColumns=True)


@query("s2_json_scan", f"""
SELECT 'c' || conv_id || ':' || turn AS conv_id, {_SPEAKER} AS speaker, text FROM conversations WHERE text <> ''""")
def s2_scan(spark, d):
    """Lists of dialogues in files."""
    entry = F.to_json(F.struct(
        F.concat(F.lit("c"), F.concat_ws(":", "conv_id", "turn")).alias("transcript_id"),
        F.array(F.struct(F.col("role").alias("speaker"), "text")).alias("turns")))
    path = _written_lists(spark, B.table(spark, d, "conversations").select(entry.alias("value")))
    return J.load_utterances(spark, path).utterances.select("conv_id", "speaker", "text")


@query("s5_query_file", """SELECT text AS "Query" FROM conversations WHERE text <> ''""")
def s5(spark, d):
    """Queries in their file, read back."""
    path = shared_path(spark, "queries")
    rows = B.table(spark, d, "conversations").where("text <> ''")
    sinks.write_queries_csv(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("rank"), F.col("text").alias("query")), path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("s6_metrics_file", """
SELECT (row_number() OVER (ORDER BY lang) - 1)::VARCHAR AS cluster_id, lang AS label, n AS size, lang || n AS summary, 4 AS clusters_found
FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)""")
def s6(spark, d):
    """Cluster metrics in their file, read back."""
    path = shared_path(spark, "metrics")
    found = B.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("size"))
    number = F.row_number().over(Window.orderBy("lang")) - 1       # one row a language
    clusters = found.select(number.alias("cluster_id"), F.col("lang").alias("action_label"), "size",
                            F.concat("lang", F.col("size").cast("string")).alias("summary"))
    sinks.write_metrics_json(clusters, {"clusters_found": 4}, path)
    read = spark.read.schema("clusters_found int, clusters map<string, struct<label: string, size: bigint, summary: string>>").json(path)
    return read.select("clusters_found", F.explode("clusters").alias("cluster_id", "c")).select("cluster_id", "c.*", "clusters_found")
