from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from flockscan.operators import neighbours as near
from flockscan.plans.coordination import coordinated_groups, group_members
from flockscan.sources.vectors import random_vectors


@pytest.fixture(scope="module")
def cloud(spark):
    """Vectors of which a third are copies of one, others share coordinates."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 5)).astype(np.float32)
    x[50:100] = x[5]
    x[100:110] = x[111]
    x[:40] = np.round(x[:40])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    return df.cache(), x.astype(float)


def brute(queries, base, k, exclude_self, query_ids=None):
    out = []
    for i, q in enumerate(queries):
        qid = i if query_ids is None else query_ids[i]
        gaps = ((base - q) ** 2).sum(axis=1)
        order = sorted((d, j) for j, d in enumerate(gaps) if not (exclude_self and j == qid))[:k]
        out += [(qid, rank, j, round(d, 9)) for rank, (d, j) in enumerate(order, 1)]
    return sorted(out)


def rows(found):
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in found.collect())


WAYS = [
    {},
    {"broadcast_bytes": 0, "block_rows": 8},
    {"broadcast_bytes": 0, "block_rows": 1000},
]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("k", [1, 4, 200])
def test_equals_brute_force(cloud, way, exclude_self, k):
    df, x = cloud
    found = near.nearest_neighbours(df, k=k, exclude_self=exclude_self, **way)
    assert rows(found) == brute(x, x, k, exclude_self)


@pytest.mark.parametrize("way", WAYS)
def test_other_base_and_far_origin(spark, cloud, way):
    df, x = cloud
    # Far from the origin a product of matrices loses the small differences.
    moved = df.select("vec_id", F.transform("embedding", lambda v: v + F.lit(3000.0)).alias("embedding"))
    y = np.array([r[1] for r in moved.orderBy("vec_id").collect()], dtype=np.float32).astype(float)
    queries = moved.filter("vec_id < 20")
    found = near.nearest_neighbours(queries, moved, k=3, **way)
    assert rows(found) == brute(y[:20], y, 3, False)


def test_self_is_nearest_and_distances_rise(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = near.nearest_neighbours(vectors, k=4)
    first = found.filter("rank = 1")
    assert first.filter("query_id <> neighbour_id or dist2 > 1e-12").isEmpty()
    assert found.count() == 4 * vectors.count()


def test_empty_base_and_bad_dimensions(spark):
    schema = "vec_id bigint, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert near.nearest_neighbours(none, k=2).isEmpty()
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema)
    with pytest.raises(ValueError, match="1 to 2 values"):
        near.nearest_neighbours(uneven)
    missing = spark.createDataFrame([(1, [1.0]), (2, None)], schema)
    assert rows(near.nearest_neighbours(missing, k=2)) == [(1, 1, 1, 0.0)]


@pytest.mark.parametrize("broadcast_bytes", [near.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("bad", [[float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0], [1.0, 2.0, 3.0]])
def test_both_ways_refuse_the_same_vectors(spark, broadcast_bytes, bad):
    schema = "vec_id bigint, embedding array<float>"
    clean = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)] + [(50, None)], schema)
    odd = spark.createDataFrame([(99, bad)], schema)
    search = lambda *tables: near.nearest_neighbours(*tables, k=2, broadcast_bytes=broadcast_bytes, block_rows=8)
    assert search(clean).count() == 40
    for tables in ((clean.union(odd),), (clean, clean.union(odd)), (odd, clean)):
        with pytest.raises(ValueError, match="values?|value"):
            search(*tables)
    uneven = spark.createDataFrame([(1, [1.0]), (2, [2.0, 0.0, 7.0])], schema)
    with pytest.raises(ValueError, match="1 to 3 values"):
        search(uneven, clean)


def test_small_base_search_has_no_shuffle(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert "Exchange" not in plan_of(near.nearest_neighbours(vectors))


def test_block_search_never_crosses_tables(spark, cloud):
    df, _ = cloud
    plan = plan_of(near.nearest_neighbours(df, broadcast_bytes=0, block_rows=16))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan


def test_far_cells_are_not_visited(spark):
    """Well separated clusters: a query meets only the blocks of its own cluster."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 4)) * 1000
    x = (centres[np.arange(400) % 10] + rng.normal(size=(400, 4))).astype(np.float32)
    pivots = x[:40].astype(float)
    gaps = near._pivot_gaps(x.astype(float), pivots)
    home = gaps.argmin(axis=1)
    rows_of = np.bincount(home, minlength=40)
    radius = np.array([gaps[home == c, c].max(initial=0) for c in range(40)])
    cells = near._grouped(pivots, rows_of, radius, 20)
    assert sorted(cells.order) == list(range(40))
    assert 20 <= cells.blocks.sum() <= 40
    queries = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], "query_id bigint, vec array<float>"
    )
    visited = near._visits(queries, cells, 4, 3).select(F.avg(F.size("blocks"))).first()[0]
    assert visited <= 6


def test_random_vectors_are_repeatable_and_spread(spark):
    made = random_vectors(spark, 500, 8, seed=3)
    assert made.schema.simpleString() == "struct<vec_id:bigint,embedding:array<float>>"
    rows_once = made.orderBy("vec_id").collect()
    assert rows_once == random_vectors(spark, 500, 8, seed=3).orderBy("vec_id").collect()
    x = np.array([r[1] for r in rows_once])
    assert x.shape == (500, 8) and x.min() >= 0 and x.max() < 1
    assert abs(x.mean() - 0.5) < 0.02 and len(np.unique(x)) > 3900
    found = near.nearest_neighbours(made.filter("vec_id < 5"), made, k=4)
    assert [r[2] for r in found.filter("rank = 1").orderBy("query_id").collect()] == list(range(5))


def test_ends_of_the_query_table(cloud):
    df, _ = cloud
    got = sorted(r[0] for r in near.first_and_last(df, count=2).collect())
    assert got == [0, 1, 148, 149]
    assert near.first_and_last(df.limit(3)).count() == 3


def test_coordinated_groups(spark):
    spots = [0.0, 0.1, 0.2, 5.0, 5.1, 9.0]
    df = spark.createDataFrame(
        [(i, [v, 0.0]) for i, v in enumerate(spots)], "vec_id bigint, embedding array<float>"
    )
    sizes = [tuple(r) for r in coordinated_groups(df, 0.05).collect()]
    assert sizes == [(0, 3), (1, 2)]
    members = {r[0]: r[1] for r in group_members(df, 0.05).collect()}
    assert members == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}


def test_blocks_grow_with_the_base(spark, monkeypatch):
    """Small blocks of a large base would send every query out again and again."""
    seen = []

    def visits(queries, cells, *rest, known=near._visits):
        seen.append(int(cells.blocks.sum()))
        return known(queries, cells, *rest)

    monkeypatch.setattr(near, "_visits", visits)
    vectors = random_vectors(spark, 3000, 4)
    found = near.nearest_neighbours(vectors, k=3, broadcast_bytes=0, block_rows=8)
    assert rows(found) == rows(near.nearest_neighbours(vectors, k=3))
    assert seen[0] <= 2 * near.MAX_BLOCKS


def test_memory_of_a_search_is_its_base_and_tiles():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60_000, 16)).astype(np.float32)
    queries = base[:1_000].astype(float)
    tracemalloc.start()
    found = [x for x in near.Closest(base, np.arange(len(base)), 5).near(queries)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x) for x, _, _ in found) == 5_000
    # A matrix of distances alone took 32 MB before, of which several were held.
    assert peak < 3 * base.nbytes + (16 << 20)


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e-40, 1e25])
def test_any_scale(scale):
    rng = np.random.default_rng(4)
    base = (rng.normal(size=(5_000, 3)) * scale).astype(np.float32)
    base[100:140] = base[7]
    ids = rng.permutation(len(base))
    queries = base[:50].astype(float)
    for rows_, cols, dist2 in near.Closest(base, ids, 6).near(queries):
        for row in range(len(queries)):
            gap = queries[row] - base.astype(float)
            far = np.einsum("ij,ij->i", gap, gap)
            nearest = np.lexsort((ids, far))[:6]
            assert cols[rows_ == row].tolist() == nearest.tolist()
            assert dist2[rows_ == row].tolist() == far[nearest].tolist()
