"""Per-cluster profiles of utterances.

Input: one row per utterance with ``cluster``, ``id`` (the reading order), ``text``, ``speaker``
and ``embedding``. A cluster may hold any share of the rows: every step pre-aggregates on the map
side, or keeps only the first rows of a cluster before anything is shuffled. A profile reads its input
several times, so a costly input (a join, an embedding) should be handed over as a table, by ``scale.keep``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.text import unicode_words, without
from ..functions.vectors import cosine
from ..scale import INLINE_ROWS, broadcast_if_small, cut, has_at_most
from .explode import explode_values


def first_per_group(df: DataFrame, group: str | list[str], order: list[Column], n: int,
                    rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group with their 1-based rank.

    Spark limits each group before the shuffle as well, so at most ``n`` rows per group and
    task move.
    """
    keys = [group] if isinstance(group, str) else group
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def first_rows(df: DataFrame, group: str, key: str, n: int, score: str | None = None) -> DataFrame:
    """First ``n`` wide rows per group, by falling ``score`` and then by ``key``.

    Only the keys and scores are sorted; the few winners then fetch their rows.
    """
    narrow = df.select(group, key, *([score] if score else []))
    order = ([F.desc(score)] if score else []) + [F.asc(key)]
    winners = cut(first_per_group(narrow, group, order, n))
    rest = df.drop(score) if score else df
    return rest.join(broadcast_if_small(winners), [group, key])


def cluster_sizes(utterances: DataFrame) -> DataFrame:
    return utterances.groupBy("cluster").agg(F.count("*").alias("size"))


def speaker_counts(utterances: DataFrame) -> DataFrame:
    speaker = F.lower("speaker").alias("speaker")
    return utterances.groupBy("cluster", speaker).agg(F.count("*").alias("n"))


def speaker_distribution(utterances: DataFrame) -> DataFrame:
    """Speaker -> count per cluster, and the cluster's size from the same pass.

    Speakers are the normalised names, so the map stays small.
    """
    entries = F.array_sort(F.collect_list(F.struct("speaker", "n")))
    return speaker_counts(utterances).groupBy("cluster").agg(
        F.map_from_entries(entries).alias("speaker_distribution"), F.sum("n").alias("size")
    )


def centroids(utterances: DataFrame) -> DataFrame:
    """Mean embedding per cluster, summed within each task first."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    return utterances.groupBy("cluster").agg(vector_to_array(mean).alias("centroid"))


def exemplars(utterances: DataFrame, k: int = fixed.N_EXEMPLARS,
              centers: DataFrame | None = None) -> DataFrame:
    """The ``k`` utterances nearest to their cluster's centroid, nearest first.

    Similarity is compared at nine digits and ties go to the smaller id.
    """
    centers = broadcast_if_small(cut(centroids(utterances)) if centers is None else centers)
    similarity = F.round(cosine(F.col("embedding"), F.col("centroid")), 9)
    scored = utterances.join(centers, "cluster").withColumn("similarity", similarity).drop("centroid")
    return first_rows(scored, "cluster", "id", k, score="similarity")


def tone(utterances: DataFrame, lexicon: DataFrame, sample: int | None = None) -> DataFrame:
    """Mean polarity of a cluster's texts, or of its first ``sample``, and the tone it stands for.

    ``lexicon`` has ``word`` and ``polarity``; of a repeated word the mean counts. A text scores the
    mean of its known words, 0 when it has none. A lexicon of measured size is looked up where the
    text lies, and one row a text is shuffled; beyond that size words meet it by a shuffle.
    """
    texts = utterances.select("cluster", "id", "text")
    first = texts if sample is None else first_rows(texts, "cluster", "id", sample)
    lexicon = broadcast_if_small(cut(lexicon.groupBy("word").agg(F.avg("polarity").alias("polarity"))))
    hits = (
        first.select("cluster", "id", F.explode_outer(unicode_words(F.col("text"))).alias("word"))
        .join(lexicon.select("word", "polarity"), "word", "left")
        .groupBy("cluster", "id").agg(F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("p"))
    )
    score = F.round(F.avg("p"), 9)
    return hits.groupBy("cluster").agg(score.alias("polarity")).withColumn(
        "tone",
        F.when(F.col("polarity") > fixed.TONE_MARGIN, "positive")
        .when(F.col("polarity") < -fixed.TONE_MARGIN, "negative")
        .otherwise("neutral"),
    )


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def phrase_scores(utterances: DataFrame, top_n: int = fixed.N_KEY_PHRASES,
                  stop_words: Sequence[str] | None = None) -> DataFrame:
    """Summed TF-IDF of each cluster's ``top_n`` most frequent terms.

    Two passes over the texts, neither of which shuffles them: the first counts terms per
    cluster; the second turns each text into its counts of those few terms and counts equal
    count vectors, since smoothed idf, the L2 norm and the sum depend on nothing else.
    """
    stop = list(english_stop_words() if stop_words is None else stop_words)
    texts = utterances.select(
        "cluster", without(unicode_words(F.col("text")), stop).alias("tokens")
    )
    counts = (
        explode_values(texts, ["cluster"], F.col("tokens"), "term")
        .groupBy("cluster", "term").agg(F.count("*").alias("n"))
    )
    vocabulary = cut(
        first_per_group(counts, "cluster", [F.desc("n"), F.asc("term")], top_n)
        .groupBy("cluster")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                         lambda t: t["term"]).alias("terms"))
    )
    vectors = (
        texts.join(broadcast_if_small(vocabulary), "cluster")
        .select(
            "cluster", "terms",
            F.transform(
                "terms", lambda term: F.size(F.filter("tokens", lambda t: t == term))
            ).alias("tf"),
        )
        .groupBy("cluster", "terms", "tf").agg(F.count("*").alias("texts"))
    )
    vectors = cut(vectors)
    long = vectors.select("cluster", "texts", "tf", F.posexplode("terms").alias("at", "term"))
    document_frequency = (
        long.groupBy("cluster", "at")
        .agg(
            F.first("term").alias("term"),
            F.sum("texts").alias("n"),
            F.sum(F.when(F.get("tf", F.col("at")) > 0, F.col("texts")).otherwise(0)).alias("df"),
        )
        .withColumn("idf", F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1)
    )
    idf = document_frequency.groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct("at", "term", "idf"))).alias("weights")
    )
    weighted = (
        vectors.join(idf, "cluster")
        .withColumn("w", F.zip_with("tf", "weights", lambda tf, w: tf * w["idf"]))
        .withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x)))
        .where("norm > 0")
        .select("cluster", "texts", "norm", F.arrays_zip("weights", "w").alias("pairs"))
        .select("cluster", "texts", "norm", F.explode("pairs").alias("pair"))
    )
    return weighted.groupBy("cluster", F.col("pair.weights.term").alias("term")).agg(
        F.sum(F.col("texts") * F.col("pair.w") / F.col("norm")).alias("score")
    )


def key_phrases(utterances: DataFrame, top_n: int = fixed.N_KEY_PHRASES,
                stop_words: Sequence[str] | None = None) -> DataFrame:
    """Ranked terms per cluster; scores are compared at nine digits, ties go alphabetically."""
    scores = phrase_scores(utterances, top_n, stop_words)
    return first_per_group(
        scores.withColumn("score", F.round("score", 9)),
        "cluster", [F.desc("score"), F.asc("term")], top_n,
    )


def _label_array() -> Column:
    return F.array_sort(F.collect_list(F.struct(
        F.col("pos").cast("bigint").alias("pos"), "label",
        F.col("vector").cast("array<double>").alias("vector"),
    )))


def nearest_label(rows: DataFrame, ontology: Mapping[str, Sequence[float]] | DataFrame,
                  vector: str = "embedding", block: int = INLINE_ROWS) -> DataFrame:
    """Add the ``action_label`` whose vector is nearest by cosine; the first label wins ties.

    The ontology is a driver-side mapping, which becomes a literal, or a DataFrame with ``pos``,
    ``label`` and ``vector``. Up to ``block`` labels travel as one array value. More labels are
    split into blocks of about that size, which are one value each: a row passes them one after another
    and keeps its best so far. Rows neither move nor need a key.
    """
    if isinstance(ontology, Mapping):
        literal = [
            F.struct(
                F.lit(i).cast("bigint").alias("pos"),
                F.lit(name).alias("label"),
                F.array(*[F.lit(float(x)) for x in values]).alias("vector"),
            )
            for i, (name, values) in enumerate(ontology.items())
        ]
        blocks = [F.array(*literal)]
    elif has_at_most(ontology, block):
        blocks = [ontology.agg(_label_array()).scalar()]
    else:
        numbered = cut(ontology.withColumn("_block", F.pmod(
            F.xxhash64("label", "pos"), F.lit(-(-ontology.count() // block)))))
        numbers = sorted(r[0] for r in numbered.select("_block").distinct().collect())
        blocks = [numbered.where(F.col("_block") == n).drop("_block").agg(_label_array()).scalar() for n in numbers]

    found = F.array_max(F.transform("_labels", lambda o: F.struct(
        F.round(cosine(F.col(vector), o["vector"]), 9).alias("similarity"),
        (-o["pos"]).alias("order"),
        o["label"].alias("label"),
    )))
    best = rows.withColumn("_labels", blocks[0]).withColumn("_best", found)
    for labels in blocks[1:]:
        best = best.withColumn("_labels", labels).withColumn("_best", F.greatest("_best", found))
    return best.select(
        *rows.columns,
        F.col("_best.label").alias("action_label"),
        F.col("_best.similarity").alias("label_similarity"),
    )


def summary(label: Column, phrases: Column, exemplar: Column) -> Column:
    return F.concat(
        F.lit("Action: "), label, F.lit(". Key themes: "),
        F.coalesce(F.array_join(phrases, ", "), F.lit("")),
        F.lit(". Example: '"), exemplar, F.lit("'"),
    )


def success_rate(utterances: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """Share of successful conversations among a cluster's utterances, NULL without outcomes."""
    if outcomes is None:
        return utterances.select("cluster").distinct().withColumn(
            "success_rate", F.lit(None).cast("double")
        )
    return (
        utterances.select("cluster", "conv_id")
        .groupBy("cluster", "conv_id").agg(F.count("*").alias("n"))
        .join(outcomes.select("conv_id", F.col("success").cast("double").alias("success")),
              "conv_id", "left")
        .groupBy("cluster")
        .agg((F.sum(F.col("n") * F.col("success"))
              / F.sum(F.when(F.col("success").isNotNull(), F.col("n")))).alias("success_rate"))
    )


def profile_clusters(utterances: DataFrame, ontology: Mapping[str, Sequence[float]] | DataFrame,
                     lexicon: DataFrame, outcomes: DataFrame | None = None,
                     stop_words: Sequence[str] | None = None, tone_sample: int | None = None) -> DataFrame:
    """One row per cluster: label, exemplars, phrases, tone, speakers, size, centroid, summary."""
    centers = cut(centroids(utterances))
    best = cut(exemplars(utterances, centers=centers).select(
        "cluster", "rank", "text", "embedding"
    ))
    labels = nearest_label(best.where("rank = 1"), ontology).select("cluster", "action_label")
    texts = best.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))),
                    lambda e: e["text"]).alias("exemplars")
    )
    phrases = key_phrases(utterances, stop_words=stop_words).groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                    lambda p: p["term"]).alias("key_phrases")
    )
    moods = tone(utterances, lexicon, tone_sample).select("cluster", "tone")
    joined = (
        speaker_distribution(utterances)
        .join(centers, "cluster").join(labels, "cluster").join(texts, "cluster")
        .join(phrases, "cluster", "left").join(moods, "cluster", "left")
    )
    if outcomes is None:
        joined = joined.withColumn("success_rate", F.lit(None).cast("double"))
    else:
        joined = joined.join(success_rate(utterances, outcomes), "cluster", "left")
    none = F.array().cast("array<string>")
    return joined.withColumn("key_phrases", F.coalesce("key_phrases", none)).select(
        F.col("cluster").alias("cluster_id"), "action_label", "exemplars", "key_phrases", "tone",
        "speaker_distribution", "size", "success_rate", "centroid",
        summary(F.col("action_label"), F.col("key_phrases"), F.get("exemplars", F.lit(0))).alias("summary"),
    )
