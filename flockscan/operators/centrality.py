"""Which nodes matter: eigenvector and betweenness centrality over edge tables.

Both work on undirected graphs, ``edges`` holding each unordered pair once, as
``undirected`` returns it.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscan.operators import paths
from flockscan.operators.components import component_roots
from flockscan.operators.graph import endpoints
from flockscan.operators.skew import number_rows
from flockscan.storage import Saved, save

# Executors receive the functions below with the plan; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pairs of a source and a node that one group of sources reaches, about.
REACHED_ROWS = 1 << 28
# Tasks that a sent graph's sources are dealt over, at least.
PATH_TASKS = 64


def _nodes(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    return endpoints(edges) if nodes is None else nodes.select("id").union(endpoints(edges)).distinct()


def _ways(edges: DataFrame, *columns: str) -> Saved:
    """``(id, other, ...)``: every edge from both of its ends, a loop from one."""
    forth = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), *columns)
    back = edges.filter("source <> target").select(F.col("target").alias("id"), F.col("source").alias("other"), *columns)
    return save(forth.union(back), "ways")


# Eigenvector centrality


def eigenvector_centrality(
    edges: DataFrame,
    nodes: DataFrame | None = None,
    tolerance: float | None = 1e-6,
    max_rounds: int = 1_000,
    name: str = "eigenvector",
) -> DataFrame:
    """``(id, eigenvector)``: the leading eigenvector of the weighted adjacency, of length one.

    A power iteration from equal scores: each node adds to its own score those of its neighbours
    times the edges' ``weight``, in parts of the largest weighted degree, so that the scale of
    the weights doesn't matter. It ends when a round moves the vector by at most ``tolerance`` and
    raises if ``max_rounds`` don't suffice; without a tolerance it makes ``max_rounds`` rounds.
    Weights are not negative. Nodes without an edge, known only from ``nodes(id)``, fall to
    0 as rounds go on.
    """
    ways = _ways(edges, F.col("weight").cast("double").alias("weight"))
    strength = ways.frame.groupBy("id").agg(F.sum("weight").alias("s")).agg(F.max("s")).first()[0]
    step = F.col("weight") / F.lit(strength or 1.0)
    square = F.sum(F.col("y") * F.col("y"))
    state = save(_nodes(edges, nodes).withColumn("y", F.lit(1.0)), "scores", square=square)
    moved = None
    for _ in range(max_rounds if state.rows else 0):
        # Scores are stored before they are scaled: their length is known once they are written.
        now = state.frame.select("id", (F.col("y") / F.lit(state.metrics["square"] ** 0.5)).alias("score"))
        told = now.select(F.col("id").alias("other"), "score")
        got = ways.frame.join(told, "other").groupBy("id").agg(F.sum(step * F.col("score")).alias("got"))
        raised = now.join(got, "id", "left").select(
            "id", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("y"), "score"
        )
        later = save(raised, "scores", square=square, along=F.sum(F.col("y") * F.col("score")))
        state.discard()
        state = later
        # Of two vectors of length one: |a - b|^2 = 2 - 2 a b.
        moved = max(0.0, 2.0 - 2.0 * state.metrics["along"] / state.metrics["square"] ** 0.5) ** 0.5
        if tolerance is not None and moved <= tolerance:
            break
    else:
        if tolerance is not None and moved is not None:
            raise RuntimeError(f"scores still move by {moved:.3g} after {max_rounds} rounds")
    length = (state.metrics["square"] or 1.0) ** 0.5
    return state.frame.select("id", (F.col("y") / F.lit(length)).alias(name))


# Betweenness


def _levels(ways: DataFrame, sources: DataFrame) -> list[Saved]:
    """``(source, id, paths)`` by distance: shortest paths from each source, counted level by level."""
    start = sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths"))
    levels = [save(start, "level")]
    while levels[-1].rows:
        ahead = levels[-1].frame.join(ways, "id").select("source", F.col("other").alias("id"), "paths", F.lit(False).alias("known"))
        # A neighbour of a level is on it, or on the one before or behind. One grouping adds up
        # paths and tells the nodes known.
        for known in levels[-2:]:
            ahead = ahead.union(known.frame.select("source", "id", F.lit(0.0), F.lit(True)))
        met = ahead.groupBy("source", "id").agg(F.sum("paths").alias("paths"), F.max("known").alias("known"))
        levels.append(save(met.filter(~F.col("known")).drop("known"), "level"))
    levels.pop().discard()
    return levels


def _group_count(edges: DataFrame, every: Saved, asked: Saved, reached_rows: int) -> int:
    """How many groups the sources make: each reaches its own component and no more."""
    if asked.rows * every.rows <= reached_rows:
        return 1
    roots = component_roots(edges, every.frame)
    sizes = roots.frame.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    met = asked.frame.join(roots.frame, "id").groupBy("root").agg(F.count(F.lit(1)).alias("asking"))
    reached = met.join(sizes, "root").agg(F.sum(F.col("asking") * F.col("n"))).first()[0] or 0
    roots.discard()
    return max(1, min(asked.rows, -(-reached // reached_rows)))


def _dependencies(ways: DataFrame, levels: list[Saved]) -> list[DataFrame]:
    """``(id, part)`` by level: what of the paths of each source runs through a node, from the farthest back."""
    parts = []
    deeper = levels[-1].frame.withColumn("part", F.lit(0.0))
    for level in reversed(levels[:-1]):
        parts.append(deeper.select("id", "part"))
        share = (1 + F.col("part")) / F.col("paths")
        given = deeper.join(ways, "id").select("source", F.col("other").alias("id"), F.lit(None).cast("double").alias("paths"), share.alias("share"))
        own = level.frame.select("source", "id", "paths", F.lit(0.0).alias("share"))
        # Shares given to nodes of other levels have no paths beside them.
        taken = own.union(given).groupBy("source", "id").agg(F.max("paths").alias("paths"), F.sum("share").alias("share"))
        part = F.col("paths") * F.col("share")
        taken = taken.filter("paths IS NOT NULL").select("source", "id", "paths", part.alias("part"))
        deeper = save(taken, "parts").frame
    # What is left is the level of the sources themselves, which are not between.
    return parts


def _by_levels(plain: DataFrame, every: Saved, asked: Saved, reached_rows: int) -> DataFrame:
    """``(id, part)``: the graph stays in its table, and sources go through it in groups."""
    ways = _ways(plain).frame
    groups = _group_count(plain, every, asked, reached_rows)
    parts: list[DataFrame] = []
    for group in range(groups):
        levels = _levels(ways, asked.frame.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == group))
        if not levels:
            continue
        # One row per node is kept of a group.
        found = reduce(DataFrame.union, _dependencies(ways, levels), ways.limit(0).select("id", F.lit(0.0).alias("part")))
        parts.append(save(found.groupBy("id").agg(F.sum("part").alias("part")), "between").frame)
        for level in levels:
            level.discard()
    total = reduce(DataFrame.union, parts, ways.limit(0).select("id", F.lit(0.0).alias("part")))
    return total.groupBy("id").agg(F.sum("part").alias("part"))


def _in_tasks(plain: Saved, asked: Saved | None) -> DataFrame:
    """``(id, part)``: the graph is sent to every task, which goes through it from its own sources."""
    spark = plain.frame.sparkSession
    numbered = save(number_rows(endpoints(plain.frame), [F.asc("id")], "number"), "numbers")
    number = F.col("number").cast("int")
    source = numbered.frame.select(F.col("id").alias("source"), number.alias("a"))
    target = numbered.frame.select(F.col("id").alias("target"), number.alias("b"))
    pairs = plain.frame.join(source, "source").join(target, "target").select("a", "b").toArrow()
    starts = None
    if asked is not None:
        starts = np.asarray(numbered.frame.join(asked.frame, "id", "left_semi").select(number).toArrow()["number"])
    graph = paths.packed(np.asarray(pairs["a"]), np.asarray(pairs["b"]), numbered.rows, starts)
    shared = spark.sparkContext.broadcast(vars(graph))
    batches = max(1, -(-len(graph.sources) // graph.width))
    tasks = min(batches, max(PATH_TASKS, 4 * spark.sparkContext.defaultParallelism))

    def parts(given):
        graph = paths.Graph(**shared.value)
        for rows in given:
            for task in rows.column("id").to_pylist():
                part = paths.through(graph, task, tasks)
                on = np.flatnonzero(part)
                yield pa.record_batch([pa.array(on), pa.array(part[on])], ["number", "part"])

    found = spark.range(0, tasks, 1, tasks).mapInArrow(parts, "number bigint, part double")
    total = found.groupBy("number").agg(F.sum("part").alias("part"))
    return save(total.join(numbered.frame, "number").select("id", "part"), "between").frame


def betweenness_centrality(
    edges: DataFrame,
    nodes: DataFrame | None = None,
    sources: DataFrame | None = None,
    normalized: bool = True,
    reached_rows: int = REACHED_ROWS,
    sent_edges: int = 0,
    name: str = "betweenness",
) -> DataFrame:
    """``(id, betweenness)``: the share of shortest paths between other nodes that run through a node.

    Paths are counted in edges, as by Brandes: shortest paths are counted from the sources
    outwards, a level at a time for all sources of a group, then shares are passed back. With
    ``sources(id)`` only paths from these nodes count, and the sum is scaled up to all nodes, an
    estimate. ``normalized`` divides by the number of pairs of other nodes. At most about
    ``reached_rows`` rows are reached by a group: sources are dealt over groups by hash, and a
    source counts with the size of its component. Loops and repeated edges don't matter; nodes
    without an edge, known only from ``nodes(id)``, have 0. A graph of at most ``sent_edges`` edges
    and a quarter as many nodes is sent to every task instead, and its sources are dealt over tasks.
    """
    plain = edges.filter("source <> target").select("source", "target").distinct()
    every = save(_nodes(edges, nodes), "nodes")
    asked = every.frame if sources is None else sources.select("id").distinct().join(every.frame, "id", "left_semi")
    chosen = save(asked, "sources")
    known = save(plain, "plain") if sent_edges else None
    if known and max(known.rows, 4 * every.rows) <= sent_edges:
        total = _in_tasks(known, None if sources is None else chosen)
    else:
        total = _by_levels(known.frame if known else plain, every, chosen, reached_rows)
    n = every.rows
    scale = n / max(1, chosen.rows)
    # Each unordered pair is met from both of its ends.
    scale *= 1 / max(1, (n - 1) * (n - 2)) if normalized else 0.5
    value = F.coalesce("part", F.lit(0.0)) * F.lit(float(scale))
    return every.frame.join(total, "id", "left").select("id", value.alias(name))
