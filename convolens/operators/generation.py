"""Causal queries from cluster profiles: seeds, expansion, dedupe and length filter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, prompts
from ..functions.rules import length_in_band
from ..functions.sections import lines_or
from .completion import complete


def theme():
    """First key phrase of a cluster, its label when there is none."""
    return F.coalesce(F.get("key_phrases", F.lit(0)), F.col("action_label"))


def seeds(clusters: DataFrame) -> DataFrame:
    """Every cluster with every template, in (cluster, template) order.

    The templates are part of the plan, so this is a projection and not a join.
    """
    filled = F.array(*[
        F.struct(
            F.lit(name).alias("template"),
            prompts.fill(text, action=F.col("action_label"), theme=F.col("theme")).alias("seed"),
        )
        for name, text in fixed.SEED_TEMPLATES
    ])
    return (
        clusters.select("cluster_id", "action_label", theme().alias("theme"))
        .select("cluster_id", F.posexplode(filled).alias("template_pos", "t"))
        .select("cluster_id", "template_pos", "t.template", "t.seed")
    )


def first_seeds(seed_rows: DataFrame, max_seeds: int | None = None) -> DataFrame:
    """The first ``max_seeds`` seeds in (cluster, template) order, all without a number."""
    if max_seeds is None:
        return seed_rows
    return seed_rows.orderBy("cluster_id", "template_pos").limit(max_seeds)


def expand_seeds(seed_rows: DataFrame, client_factory: Callable | None = None,
                 max_seeds: int | None = None, parallel_calls: int | None = None, log: str | None = None) -> DataFrame:
    """Lines of the completion of each seed; a seed without one stands for itself.

    ``max_seeds`` keeps the first seeds only.
    """
    first = first_seeds(seed_rows, max_seeds)
    asked = complete(
        first.withColumn("prompt", prompts.expand_seed(F.col("seed"))),
        "prompt", client_factory, out="response", parallel_calls=parallel_calls, log=log,
    )
    lines = lines_or(F.col("response"), F.col("seed"))
    return asked.select(
        "cluster_id", "template_pos", F.posexplode(lines).alias("line_pos", "query")
    )


def dedupe(queries: DataFrame, order: list[str]) -> DataFrame:
    """Equal queries become one, at the first of their positions (``ordinal``)."""
    return queries.groupBy("query").agg(F.min(F.struct(*order)).alias("ordinal"))


def keep_length_band(queries: DataFrame) -> DataFrame:
    """Queries of 11 to 29 words, or all of them when none is."""
    marked = queries.withColumn("_fits", length_in_band(F.col("query")))
    any_fits = marked.agg(F.coalesce(F.bool_or("_fits"), F.lit(False))).scalar()
    return marked.where(F.col("_fits") | ~any_fits).drop("_fits")


def generate_queries(clusters: DataFrame, client_factory: Callable | None = None,
                     max_queries: int = fixed.MAX_QUERIES, max_seeds: int | None = None,
                     parallel_calls: int | None = None, log: str | None = None) -> DataFrame:
    """Final queries with their rank; ``max_queries`` is their number."""
    expanded = expand_seeds(seeds(clusters), client_factory, max_seeds, parallel_calls, log)
    unique = dedupe(expanded, ["cluster_id", "template_pos", "line_pos"])
    top = keep_length_band(unique).orderBy("ordinal").limit(max_queries)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct("ordinal", "query"))).alias("q"))
    return ranked.select(F.posexplode("q").alias("p", "q")).select(
        (F.col("p") + 1).alias("rank"), F.col("q.query").alias("query")
    )
