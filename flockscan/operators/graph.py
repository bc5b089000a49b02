"""Measures of a graph kept as a table of edges and a table of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscan.operators.skew import spread_join


def undirected(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One row ``(source, target, weight)`` per unordered pair, smaller id first.

    Of repeated edges the last by ``order`` counts, or the heaviest without an order.
    """
    pairs = edges.select(
        F.least("source", "target").alias("source"),
        F.greatest("source", "target").alias("target"),
        "weight",
        *([F.col(order).alias("at")] if order else []),
    ).groupBy("source", "target")
    if order:
        return pairs.agg(F.max_by("weight", "at").alias("weight"))
    return pairs.agg(F.max("weight").alias("weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct ids that end an edge."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Listed nodes, and endpoints that were not listed with NULL attributes."""
    return nodes.join(endpoints(edges), "id", "full")


def with_attribute(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Attach computed columns to nodes by ``id``; both sides hold an id once."""
    return nodes.join(values, "id", "left")


def degrees(edges: DataFrame, nodes: DataFrame | None = None, name: str = "degree") -> DataFrame:
    """``(id, degree)``: edge ends at each node, a loop counting twice; 0 for lone nodes.

    ``edges`` must hold each unordered pair once, as ``undirected`` returns it.
    """
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    counted = ends.groupBy("id").agg(F.count(F.lit(1)).alias(name))
    if nodes is None:
        return counted
    return nodes.select("id").join(counted, "id", "left").fillna(0, [name])


def graph_stats(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row ``(nodes, edges, density)``."""
    ids = endpoints(edges) if nodes is None else nodes.select("id")
    node_count = ids.agg(F.count(F.lit(1))).scalar()
    one_row = edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("nodes", node_count)
    possible = F.col("nodes") * (F.col("nodes") - 1)
    density = F.when(F.col("nodes") > 1, 2 * F.col("edges") / possible).otherwise(F.lit(0.0))
    return one_row.select("nodes", "edges", density.alias("density"))


def subgraph(edges: DataFrame, ids: DataFrame, edge_rows: int | None = None) -> DataFrame:
    """Edges with both ends in ``ids(id)``."""
    from_inside = spread_join(
        edges, ids.select(F.col("id").alias("source")), "source", "left_semi", edge_rows
    )
    return spread_join(
        from_inside, ids.select(F.col("id").alias("target")), "target", "left_semi", edge_rows
    )


def modularity(
    edges: DataFrame, labels: DataFrame, resolution: float = 1.0, edge_rows: int | None = None
) -> DataFrame:
    """One row ``(modularity)`` of the labelling ``labels(id, label)``.

    Per community: its share of the edge weight, less ``resolution`` times the
    square of its share of all edge ends.
    """
    starts = labels.select(F.col("id").alias("source"), F.col("label").alias("source_label"))
    stops = labels.select(F.col("id").alias("target"), F.col("label").alias("target_label"))
    labelled = spread_join(edges, starts, "source", facts_rows=edge_rows)
    labelled = spread_join(labelled, stops, "target", facts_rows=edge_rows)
    same = F.col("source_label") == F.col("target_label")
    sides = F.array(
        F.struct(F.col("source_label").alias("label"), F.when(same, F.col("weight")).alias("inside")),
        F.struct(F.col("target_label").alias("label"), F.lit(None).cast("double").alias("inside")),
    )
    per_label = (
        labelled.select("weight", F.inline(sides))
        .groupBy("label")
        .agg(
            F.coalesce(F.sum("inside"), F.lit(0.0)).alias("inside"),
            F.sum("weight").alias("ends"),
        )
    )
    # Each edge has two ends, so all ends together are twice the edge weight.
    return per_label.agg(
        F.sum("inside").alias("inside"),
        F.sum("ends").alias("ends"),
        F.sum(F.col("ends") * F.col("ends")).alias("squares"),
    ).select(
        (
            F.col("inside") * 2 / F.col("ends")
            - resolution * F.col("squares") / (F.col("ends") * F.col("ends"))
        ).alias("modularity")
    )
