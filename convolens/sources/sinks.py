"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.followups import followup_rows


def write_queries_csv(queries: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """One ``Query`` column in rank order; nothing is written when there are no queries."""
    if queries.isEmpty():
        return False
    ordered = queries.orderBy("rank").select(F.col("query").alias("Query"))
    ordered.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return True


def write_metrics_json(clusters: DataFrame, stats: dict, path: str, mode: str = "overwrite") -> None:
    """Run statistics and the label, size and summary of every cluster as one JSON object."""
    about = F.struct(F.col("action_label").alias("label"), "size", "summary")
    entries = F.array_sort(F.collect_list(F.struct(F.col("cluster_id").cast("string").alias("key"), about.alias("value"))))
    columns = [F.lit(v).alias(k) for k, v in stats.items()]
    clusters.agg(F.map_from_entries(entries).alias("clusters")).select(*columns, "clusters").write.mode(mode).json(path)


def write_followups_csv(clusters: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per follow-up question, in cluster order."""
    rows = followup_rows(clusters).orderBy("cluster_id", "question_number")
    rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)
