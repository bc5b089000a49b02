"""Distances between vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(left: Column, right: Column) -> Column:
    """Squared Euclidean distance of two arrays, summed in double precision."""

    def squared_gap(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.aggregate(F.zip_with(left, right, squared_gap), F.lit(0.0), lambda total, x: total + x)
