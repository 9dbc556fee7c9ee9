"""User models over columns of numbers or texts in batches, loaded once for each Python worker.

``plugins`` runs a factory for each task.  A large model is rather kept by the worker: Spark's batch
prediction caches it there under the function that loads it.  The file of the model is added to the
session, so every executor fetches it once, also one that replaces a lost executor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import SparkFiles
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predict = Callable[[np.ndarray], np.ndarray]


def add_model(spark: SparkSession, path: str) -> str:
    """Send a model file to the executors, and return the name by which ``model_column`` loads it."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rsplit("/", 1)[-1]


def model_column(
    values: Column,
    name: str,
    load: Callable[[str], Predict],
    batch_size: int = 256,
    width: int | None = None,
) -> Column:
    """The prediction for each value; null for a null value.

    ``load`` gets the local path of the model and returns a function over a batch of texts, of numbers,
    or of vectors of one ``width``.  It returns a number, or a vector, for each row of the batch.
    """

    def make():
        return load(SparkFiles.get(name))

    shape = [[width]] if width else None
    run = predict_batch_udf(
        make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=shape
    )
    return F.when(values.isNotNull(), run(values))


def embed_with_model(
    postings: DataFrame, name: str, load: Callable[[str], Predict], batch_size: int = 256
) -> DataFrame:
    """(id, embedding) of the descriptions, as ``embed_postings`` gives them; empty texts have none."""
    text = F.when(F.col("description") != "", F.col("description"))
    # Rows without a text don't reach the model, whose batches hold no nulls.
    full = postings.where(text.isNotNull())
    empty = postings.where(text.isNull()).select("id", F.lit(None).cast("array<double>").alias("embedding"))
    return full.select("id", model_column(text, name, load, batch_size).alias("embedding")).union(empty)
