from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from flockscan.operators import communities as louvain
from flockscan.operators import components as comps
from flockscan.operators import graph, skew
from flockscan.operators.collocations import collocations
from flockscan.operators.communities import communities


def edge_table(spark, pairs, kind="bigint"):
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in pairs]
    return spark.createDataFrame(rows, f"source {kind}, target {kind}, weight double")


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, *_ in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for n in nodes:
        groups.setdefault(root(n), []).append(n)
    order = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return {n: i for i, g in enumerate(order) for n in g}


def modularity(pairs, label, resolution=1.0):
    m = sum(w for _, _, w in pairs)
    inside, ends = {}, {}
    for a, b, w in pairs:
        ends[label[a]] = ends.get(label[a], 0) + w
        ends[label[b]] = ends.get(label[b], 0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + w
    return sum(inside.values()) / m - resolution * sum((k / (2 * m)) ** 2 for k in ends.values())


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


@pytest.fixture(scope="module")
def golden(sentences):
    edges, nodes = collocations(sentences, 1, 1)
    return edges.cache(), nodes.cache()


def test_golden_measures(golden):
    edges, nodes = golden
    assert tuple(graph.graph_stats(edges, nodes).first()) == (7, 9, pytest.approx(18 / 42))
    assert as_dict(graph.degrees(edges, nodes)) == {
        "en": 2, "guerre": 2, "la": 3, "les": 3, "rdc": 3, "ukraine": 3, "élections": 2,
    }
    assert set(as_dict(comps.connected_components(edges, nodes)).values()) == {0}


def test_stats_of_tiny_graphs(spark):
    none = edge_table(spark, [])
    lone = spark.createDataFrame([(1,)], "id bigint")
    assert tuple(graph.graph_stats(none, lone).first()) == (1, 0, 0.0)
    assert tuple(graph.graph_stats(none).first()) == (0, 0, 0.0)


def test_undirected_keeps_last_or_heaviest(spark):
    ways = spark.createDataFrame(
        [(1, 2, 5.0, 0), (2, 1, 3.0, 1), (2, 3, 1.0, 2)],
        "source bigint, target bigint, weight double, at int",
    )
    assert sorted(map(tuple, graph.undirected(ways, "at").collect())) == [(1, 2, 3.0), (2, 3, 1.0)]
    assert sorted(map(tuple, graph.undirected(ways).collect())) == [(1, 2, 5.0), (2, 3, 1.0)]


def test_nodes_degrees_and_attributes(spark):
    edges = edge_table(spark, [(1, 2), (2, 3), (4, 4)])
    nodes = spark.createDataFrame([(1, "a"), (9, "z")], "id bigint, tag string")
    everyone = graph.all_nodes(nodes, edges)
    assert as_dict(everyone) == {1: "a", 2: None, 3: None, 4: None, 9: "z"}
    degrees = graph.degrees(edges, everyone)
    assert as_dict(degrees) == {1: 1, 2: 2, 3: 1, 4: 2, 9: 0}
    joined = graph.with_attribute(nodes, degrees)
    assert sorted(map(tuple, joined.collect())) == [(1, "a", 1), (9, "z", 0)]


GRAPHS = {
    "empty": ([5, 3], []),
    "loop": ([1, 2], [(1, 1)]),
    "path": (range(300), [(i, i + 1) for i in range(299)]),
    "star": (range(200), [(7, i) for i in range(200) if i != 7]),
    "repeats": ([1, 2, 3, 4], [(1, 2), (2, 1), (1, 2), (3, 4), (4, 3)]),
    "random": (
        range(400),
        [(random.Random(i).randrange(400), random.Random(-i).randrange(400)) for i in range(1, 180)],
    ),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_equal_union_find(spark, name):
    ids, pairs = GRAPHS[name]
    nodes = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = comps.connected_components(edge_table(spark, pairs), nodes)
    assert as_dict(got) == union_find(ids, pairs)


def test_components_with_hot_keys_sliced(spark, monkeypatch):
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("inner", None, None, 3))
    ids, pairs = GRAPHS["star"]
    pairs = pairs + [(1000 + i, 1001 + i) for i in range(20)]
    ids = [*ids, *range(1000, 1021)]
    nodes = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = comps.connected_components(edge_table(spark, pairs), nodes)
    assert as_dict(got) == union_find(ids, pairs)


def test_component_helpers(spark):
    edges = edge_table(spark, [(1, 2), (2, 3), (7, 8)])
    labelled = comps.connected_components(edges)
    assert as_dict(comps.component_sizes(labelled)) == {0: 3, 1: 2}
    nodes, inside = comps.largest_component(edges, labelled)
    assert sorted(r[0] for r in nodes.collect()) == [1, 2, 3]
    assert sorted((r["source"], r["target"]) for r in inside.collect()) == [(1, 2), (2, 3)]
    some = spark.createDataFrame([(2,), (3,), (7,)], "id bigint")
    assert [(r["source"], r["target"]) for r in graph.subgraph(edges, some).collect()] == [(2, 3)]
    sets = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "index int, members array<string>")
    assert as_dict(comps.sets_to_labels(sets)) == {"a": 0, "b": 0, "c": 1}


def test_modularity_equals_formula(spark):
    rng = random.Random(4)
    pairs = list({(a, b): (a, b, rng.random()) for a, b in product(range(30), repeat=2) if a < b and rng.random() < 0.2}.values())
    pairs.append((3, 3, 0.7))
    label = {i: i % 4 for i in range(30)}
    labels = spark.createDataFrame(list(label.items()), "id bigint, label int")
    for resolution in (0.5, 1.0, 2.0):
        got = graph.modularity(edge_table(spark, pairs), labels, resolution).first()[0]
        assert got == pytest.approx(modularity(pairs, label, resolution))


def test_golden_communities_reach_the_optimum(golden):
    edges, nodes = golden
    labels = as_dict(communities(edges, nodes))
    pairs = [(r["source"], r["target"], r["weight"]) for r in edges.collect()]
    assert modularity(pairs, labels) == pytest.approx(1 / 6)


def test_communities_find_planted_groups(spark):
    rng = random.Random(1)
    pairs = [
        (a, b, 1.0)
        for a, b in product(range(60), repeat=2)
        if a < b and rng.random() < (0.6 if a // 15 == b // 15 else 0.02)
    ]
    nodes = spark.createDataFrame([(i,) for i in [*range(60), 99]], "id bigint")
    edges = edge_table(spark, pairs)
    labels = as_dict(communities(edges, nodes))
    assert sorted(labels) == [*range(60), 99]
    assert modularity(pairs, labels) >= 0.95 * modularity(pairs, {i: i // 15 for i in range(60)})
    component = as_dict(comps.connected_components(edges, nodes))
    by_label = {}
    for node, label in labels.items():
        by_label.setdefault(label, set()).add(component[node])
    assert all(len(c) == 1 for c in by_label.values())


def test_communities_without_edges_and_with_loops(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert as_dict(communities(edge_table(spark, []), nodes)) == {1: 0, 2: 1}
    looped = edge_table(spark, [(1, 1, 5.0), (1, 2, 1.0), (3, 4, 2.0)])
    labels = as_dict(communities(looped, name="group"))
    assert sorted(labels) == [1, 2, 3, 4]
    assert labels[3] == labels[4] != labels[1]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    facts = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("key"), F.col("id").alias("v")
    )
    lookup = spark.range(0, 30).select(F.col("id").alias("key"), (F.col("id") * 10).alias("w"))
    plain = facts.join(lookup, "key", how)
    spread = skew.spread_join(facts, lookup, "key", how, rows_per_task=50)
    assert spread.columns == plain.columns
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


def test_number_rows(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    numbered = skew.number_rows(rows, [F.desc("g"), F.asc("id")], "n")
    got = [r["id"] for r in numbered.orderBy("n").collect()]
    assert got == sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert [r["n"] for r in numbered.select("n").orderBy("n").collect()] == list(range(5000))
    assert skew.number_rows(rows.limit(0), [F.asc("id")], "n").isEmpty()


def test_rounds_of_communities_broadcast_nothing(spark, monkeypatch):
    """A small table sent through the driver in each of many rounds adds up."""
    plans = []

    def saved(df, label, known=louvain.save, **metrics):
        plans.append(plan_of(df))
        return known(df, label, **metrics)

    monkeypatch.setattr(louvain, "save", saved)
    pairs = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source bigint, target bigint, weight double")
    found = {r["id"]: r["modularity"] for r in louvain.communities(edges).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    assert sum("SortMergeJoin" in plan for plan in plans) > 2
    assert not any("BroadcastExchange" in plan for plan in plans)


def test_late_rounds_of_levels_are_left_to_a_second_sweep(spark, monkeypatch):
    """Rounds that hardly raise modularity grew in number with the graph; the result is no worse without them."""
    rounds = []

    def one_round(*given, known=louvain._round):
        rounds.append(given)
        return known(*given)

    monkeypatch.setattr(louvain, "_round", one_round)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 32))
    near = np.argsort(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2), axis=1)[:, 1:5]
    pairs = sorted({(min(a, int(b)), max(a, int(b))) for a, row in enumerate(near) for b in row})
    pairs = [(a, b, 1.0) for a, b in pairs]
    labels = as_dict(communities(edge_table(spark, pairs)))
    assert modularity(pairs, labels) > 0.44
    assert len(rounds) <= 70
