"""Centralities against plain computations."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pytest
from conftest import plan_of

import __spark_entry__ as registered
from flockscan.operators import centrality, paths
from flockscan.operators.centrality import betweenness_centrality, eigenvector_centrality

SCHEMA = "source string, target string, weight double"


def graph(kind: str):
    rng = np.random.default_rng(3)
    if kind == "random":
        pairs = {tuple(sorted(p)) for p in rng.integers(0, 22, (30, 2)).tolist() if p[0] != p[1]}
    elif kind == "star":
        pairs = {(0, i) for i in range(1, 12)}
    elif kind == "path":
        pairs = {(i, i + 1) for i in range(6)}
    else:
        # Squares in a row: many shortest paths of equal length.
        pairs = {(i, i + 1) for i in range(8) if i % 2 == 0} | {(i, i + 2) for i in range(8)} | {(20, 21)}
    return [(f"n{a:02}", f"n{b:02}", float(rng.integers(1, 9))) for a, b in sorted(pairs)]


def plain_betweenness(edges, nodes, sources):
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    total = dict.fromkeys(nodes, 0.0)
    for s in sources:
        level, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    queue.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        part = defaultdict(float)
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    part[v] += paths[v] / paths[w] * (1 + part[w])
            if w != s:
                total[w] += part[w]
    return total


@pytest.mark.parametrize("kind", ["random", "star", "path", "squares"])
@pytest.mark.parametrize("few", [False, True])
def test_betweenness(spark, kind, few):
    edges = graph(kind)
    loops = [(edges[0][0], edges[0][0], 1.0), edges[1]]
    nodes = sorted({x for e in edges for x in e[:2]} | {"lone"})
    frame = spark.createDataFrame(edges + loops, SCHEMA).repartition(3)
    listed = spark.createDataFrame([("lone", 1)], "id string, n int")
    sources = nodes[:5] if few else nodes
    some = spark.createDataFrame([(s,) for s in sources + sources[:2] + ["absent"]], "id string") if few else None
    # Several groups of sources where all are asked for.
    found = betweenness_centrality(frame, listed, some, reached_rows=12 * len(nodes) if kind == "random" else 1 << 20)
    n = len(nodes)
    expected = plain_betweenness(edges, nodes, sources)
    values = {r["id"]: r["betweenness"] for r in found.collect()}
    assert values == pytest.approx({v: x * n / len(sources) / ((n - 1) * (n - 2)) for v, x in expected.items()})


def test_a_source_counts_with_its_component(spark, monkeypatch):
    made = []

    def levels(*given, known=centrality._levels):
        made.append(given)
        return known(*given)

    monkeypatch.setattr(centrality, "_levels", levels)
    pairs = [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(24) if i % 3 < 2]
    frame = spark.createDataFrame(pairs, SCHEMA)
    # Eight paths of three nodes: 72 pairs are reached, far fewer than the square of all nodes.
    found = betweenness_centrality(frame, normalized=False, reached_rows=100)
    assert {r["id"]: r["betweenness"] for r in found.collect()} == {f"n{i:02}": float(i % 3 == 1) for i in range(24)}
    assert len(made) == 1
    few = betweenness_centrality(frame, normalized=False, reached_rows=24)
    assert sorted(few.collect()) == sorted(found.collect())
    assert len(made) == 4


def test_betweenness_in_pairs(spark):
    frame = spark.createDataFrame(graph("path"), SCHEMA)
    found = {r["id"]: r["betweenness"] for r in betweenness_centrality(frame, normalized=False).collect()}
    assert found == {f"n{i:02}": i * (6 - i) for i in range(7)}
    assert betweenness_centrality(frame.limit(0)).count() == 0


def test_eigenvector(spark):
    scale = 1e-6
    edges = [(a, b, w * scale) for a, b, w in graph("star")] + [("n00", "n00", 9.0 * scale)]
    names = sorted({x for e in edges for x in e[:2]})
    matrix = np.zeros((len(names), len(names)))
    for a, b, w in edges:
        i, j = names.index(a), names.index(b)
        matrix[i, j] = matrix[j, i] = w
    values, vectors = np.linalg.eigh(matrix)
    leading = np.abs(vectors[:, -1])
    frame = spark.createDataFrame(edges, SCHEMA).repartition(2)
    found = {r["id"]: r["eigenvector"] for r in eigenvector_centrality(frame, tolerance=1e-3).collect()}
    assert [found[x] for x in names] == pytest.approx(leading, abs=1e-2)
    with pytest.raises(RuntimeError, match="rounds"):
        eigenvector_centrality(frame, tolerance=1e-9, max_rounds=2)
    assert eigenvector_centrality(frame.limit(0)).count() == 0


def test_a_level_takes_one_join(spark, monkeypatch):
    """Known nodes are told and shares are added by the grouping; only the step along the edges joins."""
    plans = []

    def saved(df, label, known=centrality.save, **metrics):
        if label in ("level", "parts"):
            plans.append(plan_of(df))
        return known(df, label, **metrics)

    monkeypatch.setattr(centrality, "save", saved)
    frame = spark.createDataFrame(graph("path"), SCHEMA)
    found = {r["id"]: r["betweenness"] for r in betweenness_centrality(frame, normalized=False).collect()}
    assert found == {f"n{i:02}": i * (6 - i) for i in range(7)}
    assert len(plans) > 8
    assert all(plan.count("Join") <= 1 for plan in plans)


def test_word_betweenness_starts_from_every_word(spark, tmp_path):
    """A ring of 50 words with a tail: none of its shortest paths is left to an estimate."""
    names = [f"w{i:02}" for i in range(55)]
    links = [(i, (i + 1) % 50) for i in range(50)] + [(0, 50), *((i, i + 1) for i in range(50, 54))]
    texts = [" ".join((names[a], names[b])) for a, b in links for _ in range(registered.WORD_FREQ)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["id"]: r["betweenness"] for r in registered.word_betweenness(spark, str(tmp_path)).collect()}
    expected = plain_betweenness([(names[a], names[b], 1.0) for a, b in links], names, names)
    assert found == pytest.approx({v: x / (54 * 53) for v, x in expected.items()}, abs=1e-9)


@pytest.mark.parametrize("kind", ["random", "star", "path", "squares"])
@pytest.mark.parametrize("few", [False, True])
def test_betweenness_of_a_sent_graph(spark, kind, few):
    edges = graph(kind)
    loops = [(edges[0][0], edges[0][0], 1.0), edges[1], (None, edges[0][0], 1.0)]
    nodes = sorted({x for e in edges for x in e[:2]} | {"lone"})
    frame = spark.createDataFrame(edges + loops, SCHEMA).repartition(3)
    listed = spark.createDataFrame([("lone", 1)], "id string, n int")
    some = spark.createDataFrame([(s,) for s in nodes[2:7] + ["absent"]], "id string") if few else None
    by_levels = betweenness_centrality(frame, listed, some).collect()
    sent = betweenness_centrality(frame, listed, some, sent_edges=1_000)
    assert sent.columns == ["id", "betweenness"]
    values = {r["id"]: r["betweenness"] for r in sent.collect()}
    assert values == pytest.approx({r["id"]: r["betweenness"] for r in by_levels})
    if not few:
        assert betweenness_centrality(frame, sent_edges=3).count() == len(values) - ("lone" in values)
    assert betweenness_centrality(frame.limit(0), sent_edges=3).count() == 0


@pytest.mark.parametrize("hub, cached, width", [(64, 1 << 16, 48), (3, 8, 2), (8, 64, 5)])
def test_paths_of_a_packed_graph(monkeypatch, hub, cached, width):
    monkeypatch.setattr(paths, "HUB_DEGREE", hub)
    monkeypatch.setattr(paths, "CACHED_CELLS", cached)
    monkeypatch.setattr(paths, "SIDE_BY_SIDE", width)
    rng = np.random.default_rng(hub)
    for turn in range(40):
        n = int(rng.integers(2, 50))
        pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (int(rng.integers(1, 2 * n)), 2)).tolist() if p[0] != p[1]}
        # Every other time one node is linked with all; else there are trees and components.
        pairs = sorted(pairs | ({(0, i) for i in range(1, n)} if turn % 2 else {(0, 1)}))
        names = sorted({x for pair in pairs for x in pair})
        ends = np.searchsorted(names, np.array(pairs, np.int32)).astype(np.int32)
        asked = None if turn % 3 else rng.choice(len(names), len(names) // 2 + 1, replace=False)
        packed = paths.packed(ends[:, 0], ends[:, 1], len(names), asked)
        found = sum(paths.through(packed, task, 3) for task in range(3))
        sources = names if asked is None else [names[i] for i in asked]
        expected = plain_betweenness([(*pair, 1.0) for pair in pairs], names, sources)
        assert found == pytest.approx([expected[x] for x in names])
