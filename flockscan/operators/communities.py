"""Louvain communities on edge tables.

Every round lets a share of the nodes, drawn by a hash, move at once to the
neighbouring community of greatest gain; letting all move makes neighbours trade
places for ever on dense graphs. A lone node joins another lone node only towards
the smaller label (Lu, Halappanavar and Kalyanaraman, 2015). When a round no
longer raises modularity, communities become nodes and the next level starts.

Late rounds of a level move little and their number grows with the graph, so a level
first ends at a rise that is fine enough to go on from, and a finer one follows when
levels gain no more than that (threshold scaling, Lu et al.). Afterwards the nodes of the
whole graph are tried once more from the communities found, which gains more than
the rounds left out.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscan.operators.components import number_groups
from flockscan.operators.graph import endpoints
from flockscan.operators.skew import spread_join
from flockscan.storage import Saved, save

# A move must gain more than this share of all edge weight, so rounding moves nothing.
LEAST_GAIN = 1e-12
# The rise of modularity at which levels end at first, in each sweep from the nodes upwards,
# and by how much it falls when a level rises by less.
SWEEP_RISES = (1e-3, 2e-4)
FINER = 1e-2


@dataclass
class Level:
    """One graph of the hierarchy.

    ``ways(id, other, w, k)`` has every edge in both directions, ``nodes(id, k, loop)``
    the weighted degree and the weight of loops; a loop counts twice in ``k``. An edge
    carries the degree of its ``id``, which a round needs for every edge.
    """

    ways: Saved
    nodes: Saved

    @property
    def total(self) -> float:
        return (self.nodes.metrics["ends"] or 0.0) / 2

    @property
    def option_rows(self) -> int:
        return self.ways.rows + self.nodes.rows

    def discard(self) -> None:
        self.ways.discard()
        self.nodes.discard()


def _level(edges: DataFrame, loops: DataFrame) -> Level:
    """From edges ``(source, target, w)``, possibly looped, and ``(id, loop)`` per node."""
    both = F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("other"), "w"),
        F.struct(F.col("target").alias("id"), F.col("source").alias("other"), "w"),
    )
    ways = save(
        edges.filter(F.col("source") != F.col("target"))
        .select(F.inline(both))
        .groupBy("id", "other")
        .agg(F.sum("w").alias("w")),
        "ways",
    )
    none = F.lit(0.0)
    folded = edges.filter(F.col("source") == F.col("target"))
    parts = (
        ways.frame.select("id", F.col("w").alias("k"), none.alias("loop"))
        .union(folded.select("source", none, "w"))
        .union(loops.select("id", none, "loop"))
    )
    summed = parts.groupBy("id").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
    nodes = save(
        summed.select("id", (F.col("k") + 2 * F.col("loop")).alias("k"), "loop"),
        "nodes",
        ends=F.sum("k"),
    )
    degrees = nodes.frame.select("id", "k")
    known = save(spread_join(ways.frame, degrees, "id", facts_rows=ways.rows, by_shuffle=True), "ways")
    ways.discard()
    return Level(known, nodes)


def _round(
    level: Level, state: DataFrame, resolution: float, turn: int, movers: float
) -> Saved:
    """The ``state(id, label, k, loop)`` after one round of moves.

    Two sums measured on the way give the modularity of the state before it: the
    weight each node has inside its community, and its degree times the degree of
    its community, which adds up to the squares of all community degrees.
    """
    ends = 2 * level.total
    groups = state.groupBy("label").agg(
        F.expr("sum(k) AS group_k"), F.expr("count(*) AS members")
    )
    neighbours = spread_join(
        level.ways.frame,
        state.selectExpr("id AS other", "label"),
        "other",
        facts_rows=level.ways.rows,
        by_shuffle=True,
    )
    links = (
        neighbours.selectExpr("id", "label", "w", "k", "CAST(NULL AS DOUBLE) AS loop")
        .union(state.selectExpr("id", "label", "0D AS w", "k", "loop"))
        .groupBy("id", "label")
        .agg(F.expr("sum(w) AS w"), F.expr("max(k) AS k"), F.expr("max(loop) AS loop"))
    )
    # Only the row of the own community has a loop.
    options = spread_join(links, groups, "label", facts_rows=level.option_rows, by_shuffle=True)
    # A node does not count in the degree of the community it would leave or join.
    gain = f"w - {resolution!r}D * k * if(loop IS NOT NULL, group_k - k, group_k) / {ends!r}D"
    choice = (
        options.withColumn("gain", F.expr(gain))
        .groupBy("id")
        .agg(
            F.expr(
                "min_by(struct(label, members, gain),"
                " if(loop IS NULL, struct(-gain AS loss, label), NULL)) AS best"
            ),
            F.expr(
                "max(if(loop IS NOT NULL, struct(label, members, gain, w, group_k, k, loop), NULL)) AS now"
            ),
        )
    )
    moves = f"""coalesce(
        pmod(xxhash64({turn}, id), 1000) < {round(1000 * movers)}
        AND best.gain > now.gain + {LEAST_GAIN * level.total!r}D
        AND NOT (now.members = 1 AND best.members = 1 AND best.label > now.label), false)"""
    after = choice.withColumn("moves", F.expr(moves)).selectExpr(
        "id",
        "if(moves, best.label, now.label) AS label",
        "now.k",
        "now.loop",
        "now.w + 2 * now.loop AS inside",
        "now.k * now.group_k AS square",
        "int(moves) AS moved",
    )
    return save(
        after, "state", inside=F.sum("inside"), squares=F.sum("square"), moved=F.sum("moved")
    )


def _settle(
    level: Level,
    state: DataFrame,
    resolution: float,
    movers: float,
    quiet_rounds: int,
    least_rise: float,
) -> tuple[Saved, float]:
    """The labels ``(id, label)`` of highest modularity that the rounds from ``state`` pass through.

    Modularity rises by more than ``least_rise`` at least once in ``quiet_rounds``, and it
    is at most 1, so the rounds come to an end.
    """
    best, best_q, share = state, float("-inf"), movers
    passed: list[Saved] = []
    quiet = 0
    for turn in itertools.count():
        after = _round(level, state, resolution, turn, share)
        passed.append(after)
        ends = 2 * level.total
        q = after.metrics["inside"] / ends - resolution * after.metrics["squares"] / ends**2
        # The state of a round without moves comes round again and is no news.
        if share == movers:
            quiet = 0 if q > best_q + least_rise else quiet + 1
            if q > best_q:
                best, best_q = state, q
            if quiet >= quiet_rounds:
                break
        if after.metrics["moved"]:
            state, share = after.frame.select("id", "label", "k", "loop"), movers
        elif share < 1:
            # None of those drawn could move; before giving up let all try.
            share = 1.0
        else:
            break
    labels = save(best.select("id", "label"), "labels")
    for after in passed:
        after.discard()
    return labels, best_q


def _next_level(level: Level, labels: DataFrame) -> Level:
    """Communities become nodes; edges inside one become its loop."""
    once = level.ways.frame.filter(F.col("id") < F.col("other"))
    starts = labels.select("id", F.col("label").alias("source"))
    stops = labels.select(F.col("id").alias("other"), F.col("label").alias("target"))
    moved = spread_join(once, starts, "id", facts_rows=level.ways.rows, by_shuffle=True)
    moved = spread_join(moved, stops, "other", facts_rows=level.ways.rows, by_shuffle=True)
    edges = save(
        moved.groupBy("source", "target").agg(F.sum("w").alias("w")), "moved"
    )
    loops = level.nodes.frame.join(labels.hint("merge"), "id").select(F.col("label").alias("id"), "loop")
    upper = _level(edges.frame, loops)
    edges.discard()
    return upper


def _sweep(
    base: Level, start: DataFrame, first_rise: float, resolution: float, movers: float, quiet_rounds: int, least_rise: float
) -> Saved:
    """``(id, root)`` after the levels from ``base`` upwards, its nodes moving from ``start(id, label, k, loop)``."""
    found = save(base.nodes.frame.selectExpr("id", "id AS root"), "found")
    level, reached, rise = base, float("-inf"), max(first_rise, least_rise)
    while level.total > 0:
        settled, q = _settle(level, start, resolution, movers, quiet_rounds, rise)
        if q <= reached + least_rise:
            settled.discard()
            break
        if q <= reached + rise:
            rise = max(rise * FINER, least_rise)
        reached = q
        upward = settled.frame.selectExpr("id AS root", "label")
        followed = spread_join(found.frame, upward, "root", facts_rows=found.rows, by_shuffle=True)
        onward = save(followed.selectExpr("id", "label AS root"), "found")
        found.discard()
        upper = _next_level(level, settled.frame)
        settled.discard()
        if level is not base:
            level.discard()
        found, level = onward, upper
        start = level.nodes.frame.selectExpr("id", "id AS label", "k", "loop")
    if level is not base:
        level.discard()
    return found


def communities(
    edges: DataFrame,
    nodes: DataFrame | None = None,
    resolution: float = 1.0,
    name: str = "modularity",
    movers: float = 0.6,
    quiet_rounds: int = 2,
    least_rise: float = 1e-7,
) -> DataFrame:
    """``(id, name)`` with communities numbered 0, 1, ... by falling size.

    ``edges(source, target, weight)`` holds each unordered pair once. A level ends
    when modularity has not risen by more than ``SWEEP_RISES`` tell, and in the end ``least_rise``,
    for ``quiet_rounds``. ``movers`` is the share of nodes that may move in a round; 1 suits sparse
    graphs and is faster.
    """
    weights = edges.select("source", "target", F.col("weight").cast("double").alias("w"))
    ids = endpoints(edges) if nodes is None else nodes.select("id").union(endpoints(edges))
    level = _level(weights, ids.distinct().select("id", F.lit(0.0).alias("loop")))
    start = save(level.nodes.frame.selectExpr("id", "id AS label", "k", "loop"), "start")
    for first_rise in SWEEP_RISES:
        found = _sweep(level, start.frame, first_rise, float(resolution), movers, quiet_rounds, least_rise)
        start.discard()
        if first_rise != SWEEP_RISES[-1]:
            labels = found.frame.selectExpr("id", "root AS label")
            start = save(level.nodes.frame.join(labels.hint("merge"), "id").select("id", "label", "k", "loop"), "start")
            found.discard()
    level.discard()
    return number_groups(found, name)
