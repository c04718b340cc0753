"""Text -> vector -> cluster."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import fixed
from ..functions.vectors import repair_zero
from ..scale import broadcast_if_small, cut

Encoder = Callable[[np.ndarray], np.ndarray]
STARTS_AT_ONCE = 5


def embed(texts: DataFrame, make_encoder: Callable[[], Encoder] | None = None,
          dimensions: int = 256, batch_size: int = 128) -> DataFrame:
    """Add ``embedding`` to rows with ``text``.

    ``make_encoder`` runs once per Python worker and returns a function from a batch of texts to
    a matrix. Without one, hashed term frequencies weighted by idf serve as vectors.
    """
    if make_encoder is not None:
        encode = predict_batch_udf(
            make_encoder, return_type=ArrayType(FloatType()), batch_size=batch_size
        )
        return texts.withColumn("embedding", repair_zero(encode(F.col("text"))))
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]
    encoded = Pipeline(stages=stages).fit(texts).transform(texts)
    vector = repair_zero(vector_to_array("_unit", "float32"))
    return encoded.withColumn("embedding", vector).drop("_words", "_tf", "_tfidf", "_unit")


def cluster_count(df: DataFrame, limit: int = fixed.N_CLUSTERS) -> int:
    """Never more clusters than rows, and at least one."""
    return max(1, df.limit(limit).count())


def cluster(rows: DataFrame, k: int | None = None, seed: int = 42, restarts: int = 10) -> DataFrame:
    """K-means over ``embedding``: the best of several starts, as a ``cluster`` column.

    The starts run side by side, since each of their many short steps would leave cores idle. Vectors that
    are mostly zeros are held sparse.

    Clusters are numbered by falling size, then by their smallest ``id``, so equal fits give
    equal numbers.
    """
    k = cluster_count(rows) if k is None else k
    if k == 1:
        return rows.withColumn("cluster", F.lit(0))
    points = rows.withColumn("_dense", array_to_vector(F.col("embedding")))
    # The assembler writes each vector in its shorter form.
    points = VectorAssembler(inputCols=["_dense"], outputCol="_features").transform(points).drop("_dense")
    trained = points.select("_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trained.count()

        def fit(start: int):
            return KMeans(k=k, seed=seed + start, featuresCol="_features", predictionCol="_raw").fit(trained)

        with ThreadPool(min(restarts, STARTS_AT_ONCE)) as pool:
            fits = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(restarts), chunksize=1)
        model = min(fits, key=lambda fit: fit.summary.trainingCost)
    finally:
        trained.unpersist()
    assigned = model.transform(points)
    numbers = cut(
        assigned.groupBy("_raw").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        .agg(F.array_sort(F.collect_list(
            F.struct((-F.col("n")).alias("n"), "first", "_raw"))).alias("ranked"))
        .select(F.posexplode("ranked").alias("cluster", "c"))
        .select(F.col("c._raw").alias("_raw"), "cluster")
    )
    return assigned.join(broadcast_if_small(numbers), "_raw").select(*rows.columns, "cluster")
