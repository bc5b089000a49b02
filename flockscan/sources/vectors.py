"""Vectors for trying out the neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_vectors(spark: SparkSession, rows: int, dim: int, seed: int = 1234) -> DataFrame:
    """``(vec_id, embedding)`` with values spread evenly over [0, 1), the same for a seed.

    Each value comes from a hash of its place, so a task run again makes the same ones.
    """
    steps = 1 << 24  # the values a float can tell apart in [0, 1)

    def value(place):
        return (F.pmod(F.xxhash64(F.lit(seed), "id", place), F.lit(steps)) / steps).cast("float")

    places = F.sequence(F.lit(1), F.lit(dim))
    return spark.range(rows).select(
        F.col("id").alias("vec_id"), F.transform(places, value).alias("embedding")
    )
