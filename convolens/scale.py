"""Decisions that depend on data size: lineage cuts and broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
INLINE_ROWS = 1024


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session may fall back to its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="convolens-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to reliable storage once; later readers start from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_KEPT: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; ``clear`` deletes what is written there."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path


def keep(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back.

    Like ``cut``, but later readers prune columns and push filters down. ``clear`` deletes the
    tables; it also runs when Python ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_parts(df: DataFrame, by: str, parts: tuple[str, ...]) -> dict[str, DataFrame]:
    """Like ``keep``, written once with the rows of each value of the column ``by`` as a table of its own, without that column."""
    spark = df.sparkSession
    path = shared_path(spark, "kept")
    df.write.partitionBy(by).parquet(path)
    schema = df.drop(by).schema
    out = {}
    for part in parts:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={part}")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        out[part] = spark.read.schema(schema).parquet(str(folder)) if there else spark.createDataFrame([], schema)
    return out


def release(df: DataFrame) -> None:
    """Delete one table that ``keep`` wrote, when later steps no longer read it."""
    spark, files = df.sparkSession, df.inputFiles()
    for owner, path in list(_KEPT):
        name = path.rsplit("/", 1)[1]
        if owner is not spark or not any(name in file.split("/") for file in files):
            continue
        # The folder of the file is the table's own, or that of one of its parts.
        part = next(file for file in files if name in file.split("/")).rsplit("/", 2)[1]
        if part == name:
            _KEPT.remove((owner, path))
        target = spark._jvm.org.apache.hadoop.fs.Path(path if part == name else f"{path}/{part}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``keep`` wrote; frames that read them can no longer be evaluated."""
    for owner, path in list(_KEPT):
        if owner is spark:
            _KEPT.remove((owner, path))
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear_all() -> None:
    for owner in {id(o): o for o, _ in _KEPT}.values():
        try:
            clear(owner)
        except Exception:  # the session ended before; its folder is the cluster's to clean
            continue


def footprint(df: DataFrame) -> int:
    """Size in bytes of the rows written as JSON, an upper estimate of what a broadcast ships."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    return df.agg(F.coalesce(size, F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised side for broadcast when it is small enough to be.

    Beyond the budget the side is returned as it is: Spark then joins by shuffle, and adaptive
    execution splits skewed keys.
    """
    return F.broadcast(df) if footprint(df) <= budget else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to all cores where their scan would leave most idle, else leave them as they are.

    A file with one row group is one task's work however small its splits are. For jobs with heavy work
    per row, at their beginning. The tasks with rows are counted from the files' footers, and not at all
    where there are at least as many files as cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    busy = df.select(F.spark_partition_id().alias("task")).distinct().count()
    return df if busy >= cores else df.repartition(cores)


def has_at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows

