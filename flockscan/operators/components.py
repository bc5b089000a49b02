"""Connected components of an undirected graph.

Randomised contraction (Bögeholz, Brand and Todor, 2020): each round every node
picks, among itself and its neighbours, the one whose random hash is smallest,
and then takes over the pick of that node; edges move to the picked nodes, and loops and repeats vanish. The number of
nodes falls by a constant factor per round whatever the shape of the graph, so a
long chain needs about as many rounds as a dense cluster. The picks of all
rounds, followed one after the other, give each node its component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscan.operators.graph import endpoints
from flockscan.operators.skew import number_rows, spread_join
from flockscan.storage import Saved, save

def _pairs(source: Column, target: Column, edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs without loops, the form every round works on."""
    return (
        edges.filter(source != target)
        .select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"))
        .distinct()
    )


def _picks(edges: DataFrame, seed: int) -> DataFrame:
    """``(id, pick)``: the node of smallest hash among each node and its neighbours."""

    def draw(node: Column) -> Column:
        return F.xxhash64(F.lit(seed), node)

    ways = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("a").alias("id"), F.col("b").alias("other")),
                F.struct(F.col("b").alias("id"), F.col("a").alias("other")),
            )
        )
    )
    best = ways.groupBy("id").agg(
        F.min_by("other", draw(F.col("other"))).alias("other"),
        F.min(draw(F.col("other"))).alias("other_draw"),
    )
    own_wins = draw(F.col("id")) <= F.col("other_draw")
    return best.select("id", F.when(own_wins, F.col("id")).otherwise(F.col("other")).alias("pick"))


def _two_hops(picks: DataFrame, rows: int) -> DataFrame:
    """Follow each pick once more; fewer nodes are left for the next round."""
    onward = picks.select(F.col("id").alias("pick"), F.col("pick").alias("next"))
    hopped = spread_join(picks, onward, "pick", facts_rows=rows)
    return hopped.select("id", F.col("next").alias("pick"))


def _contract(edges: Saved, picks: DataFrame) -> DataFrame:
    """Move both ends of every edge to the nodes picked for them."""
    first = picks.select(F.col("id").alias("a"), F.col("pick").alias("pick_a"))
    second = picks.select(F.col("id").alias("b"), F.col("pick").alias("pick_b"))
    moved = spread_join(edges.frame, first, "a", facts_rows=edges.rows)
    moved = spread_join(moved, second, "b", facts_rows=edges.rows)
    return _pairs(F.col("pick_a"), F.col("pick_b"), moved)


def component_roots(edges: DataFrame, nodes: DataFrame | None = None) -> Saved:
    """``(id, root)``: a root shared by exactly the nodes of one component."""
    left = save(_pairs(F.col("source"), F.col("target"), edges), "edges")
    rounds: list[Saved] = []
    while left.rows:
        # Every node ends an edge, so there are at most twice as many nodes as edges.
        hopped = _two_hops(_picks(left.frame, len(rounds)), rows=2 * left.rows)
        picks = save(hopped, "picks")
        rounds.append(picks)
        smaller = save(_contract(left, picks.frame), "edges")
        left.discard()
        left = smaller
    ids = endpoints(edges) if nodes is None else nodes.select("id").union(endpoints(edges)).distinct()
    if not rounds:
        return save(ids.withColumn("root", F.col("id")), "roots")
    roots = rounds[-1].frame
    for picks in reversed(rounds[:-1]):
        later = roots.select(F.col("id").alias("pick"), F.col("pick").alias("root"))
        followed = spread_join(picks.frame, later, "pick", "left", facts_rows=picks.rows)
        # A node that lost its last edge in this round is a root itself.
        roots = followed.select("id", F.coalesce("root", "pick").alias("pick"))
    rooted = ids.join(roots, "id", "left").select("id", F.coalesce("pick", "id").alias("root"))
    found = save(rooted, "roots")
    for done in (*rounds, left):
        done.discard()
    return found


def component_sizes(labelled: DataFrame, name: str = "component") -> DataFrame:
    """``(component, size)`` of a labelling."""
    return labelled.groupBy(name).agg(F.count(F.lit(1)).alias("size"))


def number_groups(rooted: Saved, name: str) -> DataFrame:
    """``(id, name)``: the groups of ``(id, root)``, numbered from 0 by falling size.

    Equal sizes are ordered by their smallest member.
    """
    sizes = rooted.frame.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first")
    )
    numbered = number_rows(sizes, [F.desc("n"), F.asc("first")], name).select("root", name)
    named = spread_join(
        rooted.frame,
        numbered,
        "root",
        facts_rows=rooted.rows,
        counts=sizes.select("root", "n"),
    )
    return named.select("id", name)


def connected_components(
    edges: DataFrame, nodes: DataFrame | None = None, name: str = "component"
) -> DataFrame:
    """``(id, component)`` with components numbered 0, 1, ... by falling size.

    Equal sizes are ordered by their smallest node. Nodes without an edge, known
    only from ``nodes(id)``, are components of their own.
    """
    return number_groups(component_roots(edges, nodes), name)


def sets_to_labels(sets: DataFrame, name: str = "component") -> DataFrame:
    """``(id, index)`` from rows ``(index, members)``, one row per member."""
    return sets.select(F.explode("members").alias("id"), F.col("index").alias(name))


def largest_component(
    edges: DataFrame, labelled: DataFrame, name: str = "component", edge_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the component numbered 0.

    No edge leaves a component, so its source alone decides where an edge belongs.
    """
    nodes = labelled.filter(F.col(name) == 0).select("id")
    sources = nodes.withColumnRenamed("id", "source")
    inside = spread_join(edges, sources, "source", "left_semi", facts_rows=edge_rows)
    return nodes, inside
