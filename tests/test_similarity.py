"""All pairs within a distance and the most similar vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from flockscan.operators import similarity

SCHEMA = "vec_id bigint, embedding array<float>"


def table(spark, vectors):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in vectors.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    """Clusters on a grid, so that distances tie, with copies and a missing vector."""
    rng = np.random.default_rng(2)
    made = np.repeat(rng.integers(-20, 20, (25, 3)), 12, axis=0) + rng.integers(-2, 3, (300, 3))
    found = {1000 - i: v for i, v in enumerate(made.astype(np.float32))}
    found |= {2000 + i: made[7].astype(np.float32) for i in range(40)} | {5: None}
    return found


def plain_pairs(vectors, max_dist2):
    first = {}
    for i in sorted(i for i, v in vectors.items() if v is not None):
        first.setdefault(tuple(vectors[i]), i)
    ids = sorted(first.values())
    found = set()
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            dist2 = float(((vectors[a].astype(float) - vectors[b]) ** 2).sum())
            if dist2 <= max_dist2:
                found.add((a, b, dist2))
    return found | {(first[tuple(v)], i, 0.0) for i, v in vectors.items() if v is not None and first[tuple(v)] != i}


@pytest.mark.parametrize(("max_dist2", "block_rows"), [(9.0, 20), (9.0, 100_000), (0.0, 20), (200.0, 50), (1e6, 64)])
def test_pairs_within_equal_brute_force(spark, vectors, max_dist2, block_rows):
    rows = similarity.pairs_within(table(spark, vectors), max_dist2, block_rows=block_rows).collect()
    assert len(rows) == len(set(rows))
    assert {tuple(r) for r in rows} == plain_pairs(vectors, max_dist2)


def groups(pairs):
    root = {}

    def follow(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b, *_ in pairs:
        x, y = follow(a), follow(b)
        root[max(x, y)] = min(x, y)
    return {i: follow(i) for i in root}


def test_links_connect_what_all_pairs_do(spark, vectors):
    every = plain_pairs(vectors, 9.0)
    links = {tuple(r) for r in similarity.pairs_within(table(spark, vectors), 9.0, block_rows=30, links_only=True).collect()}
    assert links < every and groups(links) == groups(every)


def test_a_forest_is_enough():
    rng = np.random.default_rng(1)
    for n in (0, 1, 400):
        a, b = rng.integers(0, 150, n), rng.integers(0, 150, n)
        kept = similarity.spanning(a, b)
        some = list(zip(a[kept].tolist(), b[kept].tolist(), strict=True))
        found, every = groups(some), groups(zip(a.tolist(), b.tolist(), strict=True))
        assert found == {i: r for i, r in every.items() if i in found}
        assert len(kept) == len(every) - len(set(every.values()))


@pytest.mark.parametrize("measure", ["inner", "cosine"])
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 40}])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_most_similar_equal_brute_force(spark, vectors, measure, options, exclude_self):
    scale = {i: None if v is None else v * (1 + i % 5) for i, v in vectors.items()} | {1: np.zeros(3, np.float32)}
    rows = similarity.most_similar(table(spark, scale), k=5, measure=measure, exclude_self=exclude_self, **options).collect()
    ids = sorted(i for i, v in scale.items() if v is not None)
    whole = np.array([scale[i] for i in ids], float)
    if measure == "cosine":
        whole /= np.where(np.linalg.norm(whole, axis=1) > 0, np.linalg.norm(whole, axis=1), 1)[:, None]
    products = whole @ whole.T
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["rank"], r["neighbour_id"], r["similarity"]))
    assert sorted(found) == ids
    for n, i in enumerate(ids):
        own = sorted(found[i])
        assert [rank for rank, *_ in own] == [1, 2, 3, 4, 5]
        best = np.sort(np.delete(products[n], n) if exclude_self else products[n])[::-1][:5]
        assert [s for *_, s in own] == pytest.approx(best, abs=1e-9)
        assert all(products[n][ids.index(j)] == pytest.approx(s, abs=1e-9) for _, j, s in own)
        if measure == "inner":
            # Whole numbers: equal products are told apart by id alone.
            order = sorted((-products[n][m], j) for m, j in enumerate(ids) if j != i or not exclude_self)
            assert [j for _, j, _ in own] == [j for _, j in order[:5]]


def test_little_and_odd_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert similarity.pairs_within(none, 1.0).count() == 0 and similarity.most_similar(none).count() == 0
    two = table(spark, {1: [1, 2], 2: [1, 2]})
    assert [tuple(r) for r in similarity.pairs_within(two, 0.0).collect()] == [(1, 2, 0.0)]
    assert similarity.pairs_within(two, -1.0).count() == 0
    assert similarity.most_similar(two, k=9).count() == 4
    with pytest.raises(ValueError, match="NaN"):
        similarity.pairs_within(table(spark, {1: [float("nan"), 0]}), 1.0)
    with pytest.raises(ValueError, match="measure"):
        similarity.most_similar(two, measure="edit")
