"""Linking question-answer pairs to clusters by substring.

A pair belongs to a cluster when the cluster's label occurs in the query, or one of its key
phrases does, or the label occurs in the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip
from ..scale import INLINE_ROWS, broadcast_if_small, cut, footprint, has_at_most, keep
from .explode import explode_values
from .profile import first_rows

_INLINE_BYTES = 1024 * 1024
_ANCHOR = 4


def _needles(clusters: DataFrame) -> DataFrame:
    """(cluster_id, term, in_response): labels may match either side, phrases only the query."""
    clean = clusters.select(
        "cluster_id",
        strip(F.lower(F.coalesce("action_label", F.lit("")))).alias("label"),
        F.transform(F.coalesce("key_phrases", F.array().cast("array<string>")),
                    lambda p: strip(F.lower(p))).alias("phrases"),
    )
    labels = clean.select("cluster_id", F.col("label").alias("term"), F.lit(True).alias("in_response"))
    phrases = clean.select("cluster_id", F.explode("phrases").alias("term"), F.lit(False).alias("in_response"))
    return labels.unionByName(phrases).where("term <> ''").distinct()


def _match_inline(needles: DataFrame, qa: DataFrame) -> DataFrame:
    """Few needles: they ride along as one array value and each pair is tested where it lies."""
    array = needles.agg(F.collect_list(F.struct("cluster_id", "term", "in_response"))).scalar()
    carried = qa.select(
        "*",
        F.lower(F.coalesce("query", F.lit(""))).alias("_q"),
        F.lower(F.coalesce("response", F.lit(""))).alias("_r"),
        array.alias("_needles"),
    )
    hits = F.filter(
        "_needles",
        lambda n: F.contains(F.col("_q"), n["term"]) | (n["in_response"] & F.contains(F.col("_r"), n["term"])),
    )
    found = F.array_distinct(F.transform(hits, lambda n: n["cluster_id"]))
    return explode_values(carried, qa.columns, found, "cluster_id").select("cluster_id", *qa.columns)


def _match_anchored(needles: DataFrame, qa: DataFrame) -> DataFrame:
    """Many needles: meet on the first characters of the needle, then verify.

    A text that contains a needle contains its first ``_ANCHOR`` characters (all of a shorter
    needle), so an equi-join on those finds every candidate. Only keys move in it. At most
    ``_ANCHOR`` sizes of beginnings occur, and only those are cut from the texts, by a look-ahead that
    passes each text once a size. The pairs are written once and read twice.
    """
    qa = keep(qa)
    anchored = needles.withColumn("gram", F.substring("term", 1, _ANCHOR))
    sizes = [r[0] for r in anchored.select(F.char_length("gram")).distinct().collect()]
    sides = {side: F.lower(F.coalesce(side, F.lit(""))) for side in ("query", "response")}

    def grams(text: Column) -> Column:
        found = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]
        return F.array_distinct(F.concat(F.array().cast("array<string>"), *found))

    anchored = broadcast_if_small(anchored)
    parts = [
        explode_values(qa, ["qa_pos", F.lit(side == "response").alias("is_response")], grams(text), "gram")
        .join(anchored if side == "query" else anchored.where("in_response"), "gram")
        .select("qa_pos", "is_response", "cluster_id", "term")
        for side, text in sides.items()
    ]
    candidates = parts[0].unionByName(parts[1])
    terms = candidates.groupBy("qa_pos", "cluster_id").agg(
        F.collect_set(F.struct("term", "is_response")).alias("_terms"))
    # Each row is tested itself, so rows that share a position keep their own answers.
    found = F.exists("_terms", lambda t: F.contains(
        F.when(t["is_response"], sides["response"]).otherwise(sides["query"]), t["term"]))
    return terms.join(qa, "qa_pos").where(found).select("cluster_id", *qa.columns)


def match_pairs(clusters: DataFrame, qa: DataFrame, inline_rows: int = INLINE_ROWS) -> DataFrame:
    """Every match as ``cluster_id`` and the pair, by the way that suits the number of needles."""
    needles = cut(_needles(clusters))
    if has_at_most(needles, inline_rows) and footprint(needles) <= _INLINE_BYTES:
        return _match_inline(needles, qa)
    return _match_anchored(needles, qa)


def dedupe_queries(linked: DataFrame) -> DataFrame:
    """One row per cluster and query: the first position with the last values."""
    rest = [c for c in linked.columns if c not in ("cluster_id", "query", "qa_pos")]
    last = F.max_by(F.struct(*rest), F.col("qa_pos")).alias("last")
    return linked.groupBy("cluster_id", "query").agg(F.min("qa_pos").alias("qa_pos"), last).select(
        "cluster_id", "qa_pos", "query", "last.*"
    )


def link_qas(clusters: DataFrame, qa: DataFrame, inline_rows: int = INLINE_ROWS) -> DataFrame:
    """Linked pairs per cluster, duplicates of a query removed. Clusters without a pair have no row.

    As ``dedupe_queries``, but only positions are aggregated, which needs no sorting; the pair that
    stays for a query then fetches its values from ``qa`` by its position.
    """
    rest = [c for c in qa.columns if c not in ("query", "qa_pos")]
    kept = match_pairs(clusters, qa, inline_rows).groupBy("cluster_id", "query").agg(
        F.min("qa_pos").alias("qa_pos"), F.max("qa_pos").alias("_last"))
    values = qa.select(F.col("qa_pos").alias("_last"), *rest)
    return kept.join(values, "_last").select("cluster_id", "qa_pos", "query", *rest)


def qa_context(linked: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` pairs per cluster as an ordered array."""
    first = first_rows(linked.select("cluster_id", "qa_pos", "query", "response"), "cluster_id", "qa_pos", n)
    return first.groupBy("cluster_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "query", "response"))),
            lambda p: F.struct(p["query"].alias("query"), p["response"].alias("response")),
        ).alias("qas")
    )
