"""Exact nearest neighbours of vectors by squared Euclidean distance.

A base that fits a fixed size is sent to every task once, and the queries pass
by it without a shuffle. A larger base is cut into blocks around pivot vectors:
a query visits only the blocks that can hold one of its k nearest vectors, as the
distances to the pivots tell, and the best of each block are merged. Copies of
one vector count as one while searching, so a crowd of copies costs no more than
a single vector. Both ways give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscan.operators.skew import ROWS_PER_TASK
from flockscan.storage import save

# Executors receive the functions below with the plan; they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BROADCAST_BYTES = 64 << 20
# Vectors of one base block, and queries compared with it in one group, unless there would be many blocks.
BLOCK_ROWS = 16_384
LEAST_PART_ROWS = 1_024
# Pivot vectors are bounded in number and in total size.
MAX_PIVOTS = 1_024
MAX_PIVOT_VALUES = 1 << 22
# Values of one distance matrix inside a task.
STEP_VALUES = 1 << 22
# Queries and base vectors whose products are made at once, and how many of these share a minimum.
QUERY_ROWS, TILE_ROWS, STRETCH = 256, 4_096, 64
# Vectors compared with all pivots at once.
ROUTED_ROWS = 1_024
# Greatest length of a vector whose squares are safe in single precision.
SINGLE_RANGE, MOST_SINGLE, LEAST_SLACK = 1e18, 3e38, 1e-36
# Blocks of a base beyond small ones: with more, each query would be sent out too often.
MAX_BLOCKS = 32
# From this base size on, comparing a query outweighs moving it to another task.
SPREAD_BASE_ROWS = 4_096
# The share of the squared lengths by which a distance from a product may be off.
ROUNDING = 1e-9

RESULT = "query_id bigint, rank int, neighbour_id bigint, dist2 double"
FOUND = "query_id bigint, neighbour_id bigint, dist2 double"


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """An Arrow column of float lists as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    if flat.size != len(column) * dim:
        raise ValueError(f"every vector must have {dim} values")
    return flat.reshape(len(column), dim)


class Closest:
    """The k nearest of a fixed base, for queries ``near(queries)`` a few at a time.

    A matrix product of the centred vectors in single precision preselects; whatever could be
    among the nearest within the error of the product is measured again from the differences.
    Beside the base it holds one copy of it and tiles of fixed size.
    """

    def __init__(self, base: np.ndarray, base_ids: np.ndarray, k: int):
        self.base, self.ids, self.k = base, base_ids, k
        dim = base.shape[1]
        self.centre = base.mean(axis=0, dtype=np.float64) if len(base) else np.zeros(dim)
        square = np.empty(len(base))
        for at in range(0, len(base), TILE_ROWS):
            gap = base[at : at + TILE_ROWS] - self.centre
            square[at : at + TILE_ROWS] = np.einsum("ij,ij->i", gap, gap)
        self.wide = float(np.sqrt(square.max(initial=0.0)))
        # Squares beyond the range of single precision are left in double.
        self.kind = np.float32 if self.wide < SINGLE_RANGE else np.float64
        # [b, b*b] times [-2q, 1] is the squared distance less the square of the query.
        self.stored = np.empty((len(base), dim + 1), dtype=self.kind)
        for at in range(0, len(base), TILE_ROWS):
            self.stored[at : at + TILE_ROWS, :dim] = base[at : at + TILE_ROWS] - self.centre
        self.stored[:, dim] = square

    def near(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row numbers ``(query, base)`` and distances of the k nearest, ties by base id."""
        for start in range(0, len(queries), QUERY_ROWS):
            rows, cols, dist2 = self._few(queries[start : start + QUERY_ROWS])
            yield start + rows, cols, dist2

    def _few(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, dim, k = len(queries), self.base.shape[1], self.k
        own = queries - self.centre
        square = np.einsum("ij,ij->i", own, own)
        kind = self.kind if np.sqrt(square.max(initial=0.0)) < SINGLE_RANGE else np.float64
        asked = np.empty((n, dim + 1), dtype=kind)
        asked[:, :dim] = -2.0 * own
        asked[:, dim] = 1.0
        # Twice the rounding of the vectors, of their product and of the limit itself.
        slack = 2.0 * (dim + 8) * np.finfo(kind).eps * (np.sqrt(square) + self.wide) ** 2 + LEAST_SLACK
        limit = np.full(n, np.inf)
        rows, cols, dist2 = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(self.base), TILE_ROWS):
            tile = self.stored[at : at + TILE_ROWS]
            rough = asked @ (tile if tile.dtype == kind else tile.astype(kind)).T
            if not at and rough.shape[1] > k:
                limit = self._bound(rough) + slack
            if kind is np.float32:
                below = rough <= np.clip(limit, -MOST_SINGLE, np.inf).astype(np.float32)[:, None]
            else:
                below = rough <= limit[:, None]
            row, col = np.divmod(np.flatnonzero(below), rough.shape[1])
            if not len(row):
                continue
            col += at
            far = np.empty(len(row))
            room = max(1, STEP_VALUES // max(1, 4 * dim))
            for x in range(0, len(row), room):
                gap = queries[row[x : x + room]] - self.base[col[x : x + room]].astype(np.float64)
                far[x : x + room] = np.einsum("ij,ij->i", gap, gap)
            rows, cols, dist2 = np.r_[rows, row], np.r_[cols, col], np.r_[dist2, far]
            order = np.lexsort((self.ids[cols], dist2, rows))
            order = order[_place(rows[order]) < k]
            rows, cols, dist2 = rows[order], cols[order], dist2[order]
            full = np.flatnonzero(_place(rows) == k - 1)
            limit[rows[full]] = dist2[full] - square[rows[full]] + slack[rows[full]]
        return rows, cols, dist2

    def _bound(self, rough: np.ndarray) -> np.ndarray:
        """A bound of each row's k-th smallest: the least of stretches tell it without a full selection."""
        n, width = rough.shape
        stretches = width // STRETCH
        if 4 * self.k <= stretches:
            rough = rough[:, : stretches * STRETCH].reshape(n, stretches, STRETCH).min(axis=2)
        return np.partition(rough, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)


def _place(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal values."""
    if not len(groups):
        return np.zeros(0, dtype=np.int64)
    fresh = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    lengths = np.diff(np.r_[fresh, len(groups)])
    return np.arange(len(groups)) - np.repeat(fresh, lengths)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few enough at a time for matrices with a column per pivot."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROUTED_ROWS):
            yield batch.slice(at, ROUTED_ROWS)


def _vectors(df: DataFrame, id_col: str, vec_col: str, name: str) -> DataFrame:
    return df.filter(F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias(name), F.col(vec_col).cast("array<float>").alias("vec")
    )


def _measure(vectors: DataFrame) -> tuple[int, int]:
    """Number of vectors and their dimension; refuses vectors without a distance.

    Both ways of searching would compare them differently, so none of them is let through.
    """
    length = F.size("vec")
    endless = F.lit(float("inf"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == endless))
    seen = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(length).alias("low"),
        F.max(length).alias("high"),
        F.count_if(odd).alias("odd"),
    ).first()
    if seen["odd"]:
        raise ValueError(f"{seen['odd']} vectors have a missing, NaN or infinite value")
    if seen["n"] and seen["low"] != seen["high"]:
        raise ValueError(f"vectors have {seen['low']} to {seen['high']} values")
    return seen["n"], seen["high"] or 0


def _spread(queries: DataFrame, base_rows: int) -> DataFrame:
    if base_rows < SPREAD_BASE_ROWS:
        return queries
    spark = queries.sparkSession
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return queries.repartition(tasks, "query_id")


def _against_whole_base(
    queries: DataFrame, base: DataFrame, rows: int, dim: int, k: int, exclude_self: bool
) -> DataFrame:
    table = base.toArrow()
    shared = base.sparkSession.sparkContext.broadcast(
        (
            table["base_id"].to_numpy(),
            _matrix(table["vec"], dim).astype(np.float32),
        )
    )
    wanted = k + 1 if exclude_self else k

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_ids, vectors = shared.value
        closest = Closest(vectors, base_ids, wanted)
        for batch in batches:
            ids = batch.column("query_id").to_numpy()
            queries = _matrix(batch.column("vec"), dim)
            for q, b, dist2 in closest.near(queries):
                q, found = ids[q], base_ids[b]
                if exclude_self:
                    other = q != found
                    q, found, dist2 = q[other], found[other], dist2[other]
                place = _place(q)
                keep = place < k
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(q[keep]),
                        pa.array((place[keep] + 1).astype(np.int32)),
                        pa.array(found[keep]),
                        pa.array(dist2[keep]),
                    ],
                    names=["query_id", "rank", "neighbour_id", "dist2"],
                )

    return _spread(queries, rows).mapInArrow(search, RESULT)


def _distinct_vectors(base: DataFrame, keep: int) -> DataFrame:
    """``(print, vec, ids)``: each vector once, with the smallest ``keep`` of its ids.

    No query can need more ids of one vector. The limit on the rank is applied
    before the shuffle too, so a crowd of copies never meets in one task.
    """
    in_order = Window.partitionBy("print", "vec").orderBy("base_id")
    return (
        base.withColumn("print", F.xxhash64("vec"))
        .withColumn("copy", F.row_number().over(in_order))
        .filter(F.col("copy") <= keep)
        .groupBy("print", "vec")
        .agg(F.sort_array(F.collect_list("base_id")).alias("ids"))
    )


@dataclass
class Cells:
    """Pivot vectors, and how the cells around them are put into blocks.

    Cells of pivots close to each other share a group. A group is one block, or
    several if its only cell is too large for one. ``order`` lists the cells group
    by group, ``starts`` where each group begins in it.
    """

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    first_block: np.ndarray
    blocks: np.ndarray

    def group_of_cell(self) -> np.ndarray:
        sizes = np.diff(np.r_[self.starts, len(self.order)])
        groups = np.empty(len(self.order), dtype=np.int64)
        groups[self.order] = np.repeat(np.arange(len(self.starts)), sizes)
        return groups


def _grouped(pivots: np.ndarray, rows: np.ndarray, radius: np.ndarray, block_rows: int) -> Cells:
    """Walk from pivot to nearest unused pivot and fill blocks with their cells on the way."""
    gaps = _pivot_gaps(pivots, pivots)
    order = np.zeros(len(pivots), dtype=np.int64)
    left = np.ones(len(pivots), dtype=bool)
    left[0] = False
    for at in range(1, len(pivots)):
        order[at] = np.where(left, gaps[order[at - 1]], np.inf).argmin()
        left[order[at]] = False
    starts, filled = [], 0
    for at, cell in enumerate(order):
        if not starts or filled + rows[cell] > block_rows:
            starts.append(at)
            filled = 0
        filled += rows[cell]
    blocks = np.maximum(1, -(-np.add.reduceat(rows[order], starts) // block_rows))
    return Cells(
        pivots, rows, radius, order, np.array(starts), np.cumsum(blocks) - blocks, blocks
    )


def _pivot_gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all vectors to all pivots."""
    squares = (
        np.einsum("ij,ij->i", vectors, vectors)[:, None]
        + np.einsum("ij,ij->i", pivots, pivots)[None, :]
        - 2.0 * (vectors @ pivots.T)
    )
    return np.sqrt(np.maximum(squares, 0.0))


def _in_cells(distinct: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """Add each vector's nearest pivot ``cell`` and its distance ``gap`` from it."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            gaps = _pivot_gaps(_matrix(batch.column("vec"), dim), shared.value)
            cell = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(cell.astype(np.int32)),
                    pa.array(gaps[np.arange(len(cell)), cell]),
                ],
                names=[*batch.schema.names, "cell", "gap"],
            )

    return distinct.mapInArrow(
        assign, "print bigint, vec array<float>, ids array<bigint>, cell int, gap double"
    )


def _visits(queries: DataFrame, cells: Cells, dim: int, wanted: int) -> DataFrame:
    """Add the ``blocks`` each query must visit.

    Pivots are base vectors, so the k-th nearest pivot bounds the k-th distance.
    A cell can be left out when all of it is further away: by its radius, or as
    the plane between its pivot and the query's nearest pivot is.
    """
    shared = queries.sparkSession.sparkContext.broadcast(vars(cells))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        pivots = known["pivots"]
        between = _pivot_gaps(pivots, pivots)
        ranges = [
            np.arange(first, first + n, dtype=np.int32)
            for first, n in zip(known["first_block"], known["blocks"], strict=True)
        ]
        for batch in _slices(batches):
            vectors = _matrix(batch.column("vec"), dim)
            gaps = _pivot_gaps(vectors, pivots)
            if len(pivots) >= wanted:
                reach = np.partition(gaps, wanted - 1, axis=1)[:, wanted - 1]
            else:
                reach = np.full(len(gaps), np.inf)
            home = gaps.argmin(axis=1)
            home_gap = gaps[np.arange(len(gaps)), home]
            apart = between[home]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (gaps**2 - home_gap[:, None] ** 2) / (2.0 * apart)
            plane[~np.isfinite(plane)] = 0.0
            nearest = np.maximum(gaps - known["radius"][None, :], plane)
            # These are not squared, so their error is the square root of the rounding share.
            slack = np.sqrt(ROUNDING) * (gaps.max(axis=1) + np.abs(vectors).max(initial=0.0))
            needed = (nearest <= (reach + slack)[:, None]) & (known["rows"] > 0)[None, :]
            visited = np.logical_or.reduceat(needed[:, known["order"]], known["starts"], axis=1)
            lists = [
                np.concatenate([ranges[g] for g in np.flatnonzero(row)] or [np.zeros(0, np.int32)])
                for row in visited
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, type=pa.list_(pa.int32()))],
                names=[*batch.schema.names, "blocks"],
            )

    return queries.mapInArrow(choose, "query_id bigint, vec array<float>, blocks array<int>")


def _in_blocks(
    queries: DataFrame,
    base: DataFrame,
    dim: int,
    k: int,
    exclude_self: bool,
    block_rows: int,
) -> DataFrame:
    spark = base.sparkSession
    wanted = k + 1 if exclude_self else k
    distinct = save(_distinct_vectors(base, wanted), "distinct")
    most = max(1, min(MAX_PIVOTS, MAX_PIVOT_VALUES // max(1, dim)))
    count = min(most, max(wanted, int(2 * distinct.rows**0.5)))
    # At most MAX_PIVOTS vectors, drawn by hash; the table is a top-n, not a sort.
    drawn = distinct.frame.orderBy(F.xxhash64("print"), "print").limit(count).select("vec")
    pivots = _matrix(drawn.toArrow()["vec"], dim)
    placed = save(_in_cells(distinct.frame, pivots, dim), "cells")

    rows, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    per_cell = placed.frame.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")
    )
    for row in per_cell.collect():  # one row per pivot
        rows[row["cell"]], radius[row["cell"]] = row["n"], row["radius"]
    # A block holds more where there would be very many: what is sent grows with their number.
    block_rows = max(block_rows, min(4 * BLOCK_ROWS, -(-distinct.rows // MAX_BLOCKS)))
    cells = _grouped(pivots, rows, radius, block_rows)

    routed = save(_visits(queries, cells, dim, wanted), "routed", visits=F.sum(F.size("blocks")))
    # Fewer queries per group where there would be too few groups to fill all cores.
    even = (routed.metrics["visits"] or 0) // (4 * spark.sparkContext.defaultParallelism)
    part_rows = min(max(block_rows, BLOCK_ROWS), max(LEAST_PART_ROWS, even))
    loads = save(
        routed.frame.select(F.explode("blocks").alias("block"))
        .groupBy("block")
        .agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")),
        "loads",
    ).frame
    if int(cells.blocks.sum()) <= ROWS_PER_TASK:
        loads = F.broadcast(loads)

    layout = spark.createDataFrame(
        [
            (cell, int(cells.first_block[group]), int(cells.blocks[group]))
            for cell, group in enumerate(cells.group_of_cell())
        ],
        "cell int, first_block int, cell_blocks int",
    )
    # A full cell is cut by hash, and the queries of a busy block into parts, so no
    # group below outgrows its bound on either side by more than chance.
    blocks = (
        placed.frame.join(F.broadcast(layout), "cell")
        .withColumn(
            "block",
            (F.col("first_block") + F.pmod("print", "cell_blocks")).cast("int"),
        )
        .join(loads, "block")
        .select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ids", "vec")
    )
    visits = (
        routed.frame.select("query_id", "vec", F.explode("blocks").alias("block"))
        .join(loads, "block")
        .select("block", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part"), "query_id", "vec")
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["query_id"].to_numpy()
        copies = left["ids"].combine_chunks()
        starts = copies.offsets.to_numpy()
        copy_ids = copies.values.to_numpy()
        lengths = np.diff(starts)
        outs = []
        if len(ids) and len(copies):
            first_ids = copy_ids[starts[:-1]]
            base = _matrix(left["vec"], dim)
            for q, b, dist2 in Closest(base, first_ids, wanted).near(_matrix(right["vec"], dim)):
                times = lengths[b]
                at = np.repeat(starts[b], times) + _place(np.repeat(np.arange(len(b)), times))
                q, dist2, found = np.repeat(ids[q], times), np.repeat(dist2, times), copy_ids[at]
                if exclude_self:
                    other = q != found
                    q, dist2, found = q[other], dist2[other], found[other]
                order = np.lexsort((found, dist2, q))
                q, dist2, found = q[order], dist2[order], found[order]
                keep = _place(q) < k
                outs.append((q[keep], found[keep], dist2[keep]))
        columns = zip(*outs, strict=True) if outs else ([], [], [])
        kinds = (np.int64, np.int64, np.float64)
        arrays = [np.concatenate([*c, np.zeros(0, t)]).astype(t) for c, t in zip(columns, kinds, strict=True)]
        return pa.table(arrays, names=["query_id", "neighbour_id", "dist2"])

    found = (
        blocks.groupBy("block", "part")
        .cogroup(visits.groupBy("block", "part"))
        .applyInArrow(search, FOUND)
    )
    best = Window.partitionBy("query_id").orderBy("dist2", "neighbour_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "neighbour_id", "dist2")
    )


def nearest_neighbours(
    queries: DataFrame,
    base: DataFrame | None = None,
    k: int = 4,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, neighbour_id, dist2)``: the ``k`` nearest base vectors of each query.

    ``dist2`` is the squared distance; equal distances are ranked by id. Without
    ``base`` the queries are searched among themselves, each then being its own
    nearest unless ``exclude_self``. Fewer than ``k`` rows come back when the base
    is smaller. Ids are unique integers. Vectors that are NULL as a whole are left out on
    both sides; a missing, NaN or infinite value, or vectors of different length, raise.
    """
    wanted_base = _vectors(queries if base is None else base, id_col, vec_col, "base_id")
    asked = _vectors(queries, id_col, vec_col, "query_id")
    rows, dim = _measure(wanted_base)
    if base is not None:
        asked_rows, asked_dim = _measure(asked)
        if rows and asked_rows and asked_dim != dim:
            raise ValueError(f"queries have {asked_dim} values, the base has {dim}")
    if not rows:
        return asked.sparkSession.createDataFrame([], RESULT)
    if rows * dim * 4 <= broadcast_bytes:
        return _against_whole_base(asked, wanted_base, rows, dim, k, exclude_self)
    return _in_blocks(asked, wanted_base, dim, k, exclude_self, block_rows)


def first_and_last(queries: DataFrame, id_col: str = "vec_id", count: int = 5) -> DataFrame:
    """The first and the last few queries by id, to look at just their neighbours."""
    first = queries.orderBy(id_col).limit(count)
    last = queries.orderBy(F.desc(id_col)).limit(count)
    return first.union(last).dropDuplicates([id_col])


def neighbour_edges(found: DataFrame, max_dist2: float | None = None) -> DataFrame:
    """Undirected edges ``(source, target, weight)`` between neighbours, each pair once.

    The weight is 1; ``max_dist2`` leaves out pairs further apart.
    """
    pairs = found.filter(F.col("query_id") != F.col("neighbour_id"))
    if max_dist2 is not None:
        pairs = pairs.filter(F.col("dist2") <= max_dist2)
    return (
        pairs.select(
            F.least("query_id", "neighbour_id").alias("source"),
            F.greatest("query_id", "neighbour_id").alias("target"),
        )
        .distinct()
        .withColumn("weight", F.lit(1.0))
    )
