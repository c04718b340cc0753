"""Question-answer pairs in JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..scale import broadcast_if_small
from .blocks import JSON_LIST, list_items, split_records

_PAIRS = "qa_pos bigint, query string, response string, confidence double"
_REJECTED = "source string, pos bigint, error string"
_FILE_BITS = 40


@dataclass(frozen=True)
class LoadedPairs:
    """``pairs`` are ``qa_pos, query, response, confidence``; ``rejected`` are ``source, pos, error``."""

    pairs: DataFrame
    rejected: DataFrame


def _fields(item: Column) -> list[Column]:
    """The fields as text. A confidence that is no number is null and takes nothing else with it."""
    def text(key):
        return F.try_variant_get(item, f"$.{key}", "string")
    return [text("query").alias("query"), text("response").alias("response"),
            text("confidence").try_cast("double").alias("confidence")]


def _pairs(rows: DataFrame, position: Column, kept: list) -> tuple[DataFrame, DataFrame]:
    """Pairs of the objects in ``item`` and the rows that are none."""
    is_object = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    return (rows.where(is_object).select(position.alias("qa_pos"), *_fields(F.col("item"))),
            rows.where(~is_object).select(*kept, F.lit("no object").alias("error")))


def _lines(spark: SparkSession, path: str) -> LoadedPairs:
    rows = spark.read.text(path).where("trim(value) <> ''").select(
        F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("pos"),
        F.try_parse_json("value").alias("item"))
    pairs, strange = _pairs(rows.where("item is not null"), F.col("pos"), ["source", "pos"])
    broken = rows.where("item is null").select("source", "pos", F.lit("no valid JSON").alias("error"))
    return LoadedPairs(pairs, strange.union(broken))


def load_qa_pairs(spark: SparkSession, path: str, lines: bool = False) -> LoadedPairs:
    """Pairs of JSON lists, one a file, or of JSON Lines; files of either kind are read by many tasks.

    Lists are read item by item: one that cannot be read, or is no object, is rejected and the others
    stay. A document that is no list is rejected whole. ``qa_pos`` rises in reading order. A missing path
    gives no rows.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", True)
    try:
        if lines:
            return _lines(spark, path)
        records, heads = split_records(spark, path, JSON_LIST, "[")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return LoadedPairs(spark.createDataFrame([], _PAIRS), spark.createDataFrame([], _REJECTED))
    # One row a file.
    files = heads.select("file", "head", F.row_number().over(Window.orderBy("file")).alias("number"))
    lists = broadcast_if_small(files.where("head = '['"))
    items, broken = list_items(records)
    position = F.shiftleft((F.col("number") - 1).cast("bigint"), _FILE_BITS) + F.col("pos")
    pairs, strange = _pairs(items.join(lists, "file"), position, [F.col("file").alias("source"), "pos"])
    others = files.where("head <> '['").select("file", F.lit(None).cast("bigint"), F.lit("no list"))
    return LoadedPairs(pairs, strange.union(broken).union(others))


def read_qa_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The pairs of ``load_qa_pairs``; ask that function for what could not be read."""
    return load_qa_pairs(spark, path, lines).pairs
