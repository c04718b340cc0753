"""Cluster profiles, seeds and generated queries."""

from pyspark.sql import functions as F

from convolens.functions import fixed
from convolens.functions.sections import lines_or
from convolens.functions.vectors import cosine, repair_zero
from convolens.operators import generation, profile
from convolens.operators.embedding import cluster, cluster_count, embed
from convolens.plans import jobs
from convolens.scale import broadcast_if_small, cut

from . import bindings as B
from .registry import query

_U = ("utter",)


@query("a1_cluster_size", B.sql("SELECT cluster, count(*) AS size FROM utter GROUP BY 1", *_U))
def a1(spark, d):
    return profile.cluster_sizes(B.utter(spark, d))


@query("a2_speaker_counts", B.sql("SELECT cluster, lower(speaker) AS speaker, count(*) AS n FROM utter GROUP BY 1, 2", *_U))
def a2(spark, d):
    spread = profile.speaker_distribution(B.utter(spark, d))
    return spread.select("cluster", F.explode("speaker_distribution").alias("speaker", "n"))


@query("a3_centroid", B.sql("SELECT cluster, unnest(range(64)) AS at, round(unnest(centroid), 6) AS mean FROM centers", "utter", "centers"))
def a3(spark, d):
    at = profile.centroids(B.utter(spark, d)).select("cluster", F.posexplode("centroid").alias("at", "mean"))
    return at.select("cluster", F.col("at").cast("bigint").alias("at"), F.round("mean", 6).alias("mean"))


_TONE = r"""
SELECT cluster, round(p, 6) AS polarity, CASE WHEN p > 0.1 THEN 'positive' WHEN p < -0.1 THEN 'negative' ELSE 'neutral' END AS tone FROM (
  SELECT cluster, round(avg(p), 9) AS p FROM (
    SELECT cluster, id, coalesce(avg(polarity), 0) AS p FROM (
      SELECT cluster, id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}_]+')) AS word FROM utter)
    LEFT JOIN lexicon USING (word) GROUP BY cluster, id) GROUP BY cluster)"""


@query("a4_tone", B.sql(_TONE, "utter", "lexicon"))
def a4(spark, d):
    return profile.tone(B.utter(spark, d), B.lexicon(spark)).withColumn("polarity", F.round("polarity", 6))


B.VIEWS["tok"] = rf"""
  SELECT cluster, id, term, count(*) AS tf FROM (
    SELECT cluster, id, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS term FROM utter)
  WHERE length(term) >= 2 AND term NOT IN ({B.quoted(B.STOP_WORDS)}) GROUP BY 1, 2, 3"""
B.VIEWS["vocab"] = """
  SELECT cluster, term FROM (SELECT cluster, term, sum(tf) AS n FROM tok GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) <= 5"""
B.VIEWS["tfidf"] = """
  SELECT cluster, term, sum(w / norm) AS score FROM (
    SELECT cluster, id, term, w, sqrt(sum(w * w) OVER (PARTITION BY cluster, id)) AS norm FROM (
      SELECT t.cluster, t.id, t.term, t.tf * (ln((1 + n.n) / (1.0::DOUBLE + df.df)) + 1) AS w
      FROM tok t JOIN vocab USING (cluster, term)
      JOIN (SELECT cluster, term, count(*) AS df FROM tok GROUP BY 1, 2) df USING (cluster, term)
      JOIN (SELECT cluster, count(*) AS n FROM utter GROUP BY 1) n USING (cluster)))
  GROUP BY cluster, term"""
B.VIEWS["ranked_phrases"] = """
  SELECT cluster, term, round(score, 6) AS score, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rank FROM tfidf"""
_PHRASES = ("utter", "tok", "vocab", "tfidf", "ranked_phrases")


@query("a5_key_phrases", B.sql("SELECT * FROM ranked_phrases", *_PHRASES))
def a5(spark, d):
    return profile.key_phrases(B.utter_once(spark, d), stop_words=B.STOP_WORDS).withColumn("score", F.round("score", 6))


@query("a14_cluster_count", "SELECT CAST(greatest(1, least(8, count(*))) AS BIGINT) AS k FROM embeddings")
def a14(spark, d):
    return spark.createDataFrame([(cluster_count(B.table(spark, d, "embeddings")),)], "k long")


B.VIEWS["exemplar"] = """
  SELECT cluster, id, text, embedding, similarity, row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, id) AS rank FROM (
    SELECT cluster, id, text, embedding, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 9) AS similarity
    FROM utter JOIN centers USING (cluster)) QUALIFY rank <= 5"""
_EXEMPLARS = ("utter", "centers", "exemplar")


@query("w1_exemplars", B.sql("SELECT cluster, id, rank, round(similarity, 6) AS similarity FROM exemplar", *_EXEMPLARS))
def w1(spark, d):
    return profile.exemplars(B.utter_once(spark, d)).select("cluster", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query("w2_first_n", B.sql("SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY id) AS rank FROM utter QUALIFY rank <= 20", *_U))
def w2(spark, d):
    first = profile.first_per_group(B.utter(spark, d), "cluster", [F.asc("id")], fixed.TONE_SAMPLE)
    return first.select("cluster", "id", "rank")


B.VIEWS["nearest"] = """
  SELECT id, arg_max(label, row(s, -pos)) AS action_label, max(s) AS similarity FROM (
    SELECT id, label, pos, round(list_cosine_similarity(embedding::DOUBLE[], vector), 9) AS s FROM {rows}, ontology) GROUP BY id"""


@query("j3_nearest_label", B.sql(
    "SELECT id, action_label, round(similarity, 6) AS label_similarity FROM (" + B.VIEWS["nearest"].format(rows="utter") + ")",
    "utter", "centers", "ontology"))
def j3(spark, d):
    best = profile.nearest_label(B.utter(spark, d), B.ontology(spark, d))
    return best.select("id", "action_label", F.round("label_similarity", 6).alias("label_similarity"))


@query("p16_zero_repair", """
SELECT vec_id, unnest(range(64)) AS at, unnest(CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x, i: CASE WHEN i = 1 THEN 1.0::FLOAT ELSE 0 END) ELSE embedding END) AS x FROM embeddings""")
def p16(spark, d):
    rows = B.table(spark, d, "embeddings")
    zeroed = F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    return rows.select("vec_id", F.posexplode(repair_zero(zeroed)).alias("at", "x")).withColumn("at", F.col("at").cast("bigint"))


@query("x4_cosine", B.sql("SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS similarity FROM utter JOIN centers USING (cluster)", "utter", "centers"))
def x4(spark, d):
    rows = B.utter(spark, d)
    joined = rows.join(broadcast_if_small(cut(profile.centroids(rows))), "cluster")
    return joined.select("id", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))


B.VIEWS["summaries"] = """
  SELECT e.cluster, n.action_label, 'Action: ' || n.action_label || '. Key themes: ' || coalesce(p.themes, '') || '. Example: ''' || e.text || '''' AS summary
  FROM exemplar e JOIN (""" + B.VIEWS["nearest"].format(rows="(SELECT * FROM exemplar WHERE rank = 1)") + """) n USING (id)
  LEFT JOIN (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS themes FROM ranked_phrases GROUP BY 1) p USING (cluster)
  WHERE e.rank = 1"""
_SUMMARY = ("utter", "centers", "exemplar", "ontology", "tok", "vocab", "tfidf", "ranked_phrases", "summaries")


def _profiles(spark, d):
    rows = B.utter_once(spark, d)
    return profile.profile_clusters(rows, B.ontology(spark, d, rows), B.lexicon(spark), stop_words=B.STOP_WORDS)


@query("p17_summary", B.sql("SELECT cluster, md5(summary) AS summary FROM summaries", *_SUMMARY))
def p17(spark, d):
    rows = B.utter_once(spark, d)
    best = profile.exemplars(rows).where("rank = 1").select("cluster", "text", "embedding")
    labels = profile.nearest_label(best, B.ontology(spark, d, rows))
    phrases = profile.key_phrases(rows, stop_words=B.STOP_WORDS).groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda p: p["term"]).alias("phrases"))
    text = profile.summary(F.col("action_label"), F.col("phrases"), F.col("text"))
    return labels.join(phrases, "cluster", "left").select("cluster", F.md5(text).alias("summary"))


@query("a15_profiles", B.sql(f"""
SELECT s.cluster AS cluster_id, s.action_label, md5(s.summary) AS summary, t.tone, z.size, z.users, z.systems, x.exemplars
FROM summaries s JOIN ({_TONE}) t USING (cluster)
JOIN (SELECT cluster, count(*) AS size, count(*) FILTER (WHERE speaker = 'user') AS users, count(*) FILTER (WHERE speaker = 'system') AS systems FROM utter GROUP BY 1) z USING (cluster)
JOIN (SELECT cluster, md5(string_agg(text, '|' ORDER BY rank)) AS exemplars FROM exemplar GROUP BY 1) x USING (cluster)""", *_SUMMARY, "lexicon"))
def a15(spark, d):
    count = lambda name: F.coalesce(F.try_element_at("speaker_distribution", F.lit(name)), F.lit(0))
    return _profiles(spark, d).select(
        "cluster_id", "action_label", F.md5("summary").alias("summary"), "tone", "size",
        count("user").alias("users"), count("system").alias("systems"), F.md5(F.array_join("exemplars", "|")).alias("exemplars"))


@query("j8_success_rate", B.sql("""
SELECT cluster, round(avg(CASE WHEN quality IS NOT NULL THEN quality::DOUBLE END), 6) AS success_rate
FROM utter LEFT JOIN labels ON labels.doc_id = utter.id GROUP BY cluster""", *_U))
def j8(spark, d):
    outcomes = B.table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), F.col("quality").alias("success"))
    rate = profile.success_rate(B.utter(spark, d).withColumn("conv_id", F.col("id")), outcomes)
    return rate.select("cluster", F.round("success_rate", 6).alias("success_rate"))


_TEMPLATES = " UNION ALL ".join(
    f"SELECT {i} AS template_pos, '{name}' AS template, '{text}' AS body" for i, (name, text) in enumerate(fixed.SEED_TEMPLATES))
B.VIEWS["seeds"] = f"""
  SELECT cluster_id, template_pos, template, replace(replace(body, '{{action}}', action_label), '{{theme}}', coalesce(key_phrases[1], action_label)) AS seed
  FROM clusters, ({_TEMPLATES})"""
_CLUSTERS = ("top_words", "clusters")


@query("j2_seeds", B.sql("SELECT * FROM seeds", *_CLUSTERS, "seeds"))
def j2(spark, d):
    return generation.seeds(B.clusters(spark, d))


@query("x9_templates", B.sql("SELECT template, count(*) AS seeds FROM seeds GROUP BY 1", *_CLUSTERS, "seeds"))
def x9(spark, d):
    return generation.seeds(B.clusters(spark, d)).groupBy("template").agg(F.count("*").alias("seeds"))


@query("w6_theme", B.sql("SELECT cluster_id, coalesce(key_phrases[1], action_label) AS theme FROM clusters", *_CLUSTERS))
def w6(spark, d):
    return B.clusters(spark, d).select("cluster_id", generation.theme().alias("theme"))


B.VIEWS["all_seeds"] = "SELECT *, row_number() OVER (ORDER BY cluster_id, template_pos) AS ordinal FROM seeds"


@query("w7_seed_cap", B.sql("SELECT cluster_id, template_pos, seed FROM all_seeds WHERE ordinal <= 10", *_CLUSTERS, "seeds", "all_seeds"))
def w7(spark, d):
    first = generation.first_seeds(generation.seeds(B.clusters(spark, d)), fixed.MAX_SEEDS)
    return first.select("cluster_id", "template_pos", "seed")


@query("m7_expand_offline", B.sql("SELECT cluster_id, template_pos, 0 AS line_pos, seed AS query FROM all_seeds", *_CLUSTERS, "seeds", "all_seeds"))
def m7(spark, d):
    return generation.expand_seeds(generation.seeds(B.clusters(spark, d)))


@query("m8_generate_offline", B.sql(r"""
SELECT row_number() OVER (ORDER BY ordinal) AS rank, query FROM (
  SELECT seed AS query, min(ordinal) AS ordinal, bool_or(len(regexp_extract_all(seed, '\S+')) BETWEEN 11 AND 29) AS fits FROM all_seeds GROUP BY seed)
WHERE fits OR NOT (SELECT bool_or(len(regexp_extract_all(seed, '\S+')) BETWEEN 11 AND 29) FROM all_seeds)
ORDER BY ordinal LIMIT 50""", *_CLUSTERS, "seeds", "all_seeds"))
def m8(spark, d):
    return generation.generate_queries(B.clusters(spark, d))


@query("x10_answer_lines", r"""
SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS at FROM (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN [text] ELSE list_filter(list_transform(string_split(text, chr(10)),
         lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END AS ls FROM conversations)""")
def x10(spark, d):
    answer = F.when(F.col("role") != "system", F.col("text"))
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(lines_or(answer, F.col("text"))).alias("at", "line"))


@query("m1_embed", """
SELECT md5(text) AS text, count(*) AS n, 1 AS vectors, 256 AS dimensions, 1.0::DOUBLE AS unit FROM documents GROUP BY text""")
def m1(spark, d):
    """Equal texts have one vector, of length one."""
    rows = embed(B.table(spark, d, "documents").select("doc_id", "text"))
    unit = F.round(F.max(cosine(F.col("embedding"), F.col("embedding"))), 6)
    return rows.groupBy(F.md5("text").alias("text")).agg(
        F.count("*").alias("n"), F.count_distinct(F.xxhash64("embedding")).alias("vectors"),
        F.max(F.size("embedding")).alias("dimensions"), unit.alias("unit"))


@query("m2_cluster")
def m2(spark, d):
    rows = B.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return cluster(rows).groupBy("cluster").agg(F.count("*").alias("n"))


@query("m2_one_cluster", "SELECT vec_id AS id, 0 AS cluster FROM embeddings")
def m2_one(spark, d):
    """With one cluster there is one answer."""
    rows = B.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return cluster(rows, k=1, restarts=2).select("id", "cluster")


@query("m2_numbering", "SELECT count(*) AS points, count(DISTINCT vec_id) AS ids, 4 AS clusters, TRUE AS falling FROM embeddings")
def m2_numbering(spark, d):
    """Every point is in one cluster, and clusters are numbered by falling size."""
    rows = B.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    sizes = cluster(rows, k=4, restarts=2).groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    found = sizes.agg(F.sum("n").alias("points"), F.sum("ids").alias("ids"), F.max("cluster").alias("last"),
                      F.array_sort(F.collect_list(F.struct("cluster", "n"))).alias("c"))
    falling = F.forall(F.transform("c", lambda c, i: F.coalesce(F.get(F.col("c"), i + 1)["n"] <= c["n"], F.lit(True))), lambda x: x)
    return found.select("points", "ids", (F.col("last") + 1).alias("clusters"), falling.alias("falling"))


def _spoken(spark, d):
    return B.table(spark, d, "conversations").select(
        F.struct("conv_id", "turn").alias("id"), "text", F.when(F.col("role") == "user", "user").otherwise("system").alias("speaker"))


@query("m13_analyze")
def m13(spark, d):
    return jobs.analyze(_spoken(spark, d), lexicon=B.lexicon(spark)).drop("centroid", "exemplars")


@query("m13_one_cluster", """
SELECT 0 AS cluster_id, count(*) AS size, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role <> 'user') AS systems FROM conversations""")
def m13_one(spark, d):
    """The profile of all utterances as one cluster."""
    found = jobs.analyze(_spoken(spark, d), lexicon=B.lexicon(spark), k=1, restarts=1)
    spoken = F.col("speaker_distribution")
    return found.select("cluster_id", "size", spoken["user"].alias("users"), spoken["system"].alias("systems"))


@query("m14_query_job")
def m14(spark, d):
    loaded = B.table(spark, d, "conversations").select(
        F.lit("conversations").alias("source"), F.col("conv_id").alias("dialog_pos"), F.col("turn").alias("pos"),
        F.col("conv_id").cast("string").alias("conv_id"), "text",
        F.when(F.col("role") == "user", "user").otherwise("system").alias("speaker"))
    return jobs.run_queries(spark, loaded)
