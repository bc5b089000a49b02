"""Groups of posts that say nearly the same: close vectors, linked and grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscan.operators.components import component_sizes, connected_components
from flockscan.operators.similarity import pairs_within
from flockscan.storage import save


def close_links(vectors: DataFrame, max_dist2: float, **options) -> DataFrame:
    """``(source, target, weight)``: pairs within a squared distance that connect all such pairs."""
    found = pairs_within(vectors, max_dist2, links_only=True, **options)
    return found.select("source", "target", F.lit(1.0).alias("weight"))


def coordinated_groups(vectors: DataFrame, max_dist2: float, **options) -> DataFrame:
    """``(component, size)`` of the groups of two or more that close pairs connect."""
    edges = save(close_links(vectors, max_dist2, **options), "close").frame
    return component_sizes(connected_components(edges)).orderBy("component")


def group_members(vectors: DataFrame, max_dist2: float, **options) -> DataFrame:
    """``(id, component)`` of every vector that belongs to a group."""
    edges = save(close_links(vectors, max_dist2, **options), "close").frame
    return connected_components(edges).select("id", F.col("component"))
