"""Exact joins of vectors: all pairs within a distance, and the most similar by inner product.

Distinct vectors are dealt into cells around pivots, neighbouring cells into blocks of
bounded size. A vector visits only blocks that a bound can't rule out: for distances the
triangle inequality and the plane between two pivots, with the radius known from the
start; for inner products Cauchy-Schwarz on a cell's largest norm and on what its vectors are
off their pivot. Busy blocks are met in parts, so no task outgrows a block on either side.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscan.operators.neighbours import (
    BLOCK_ROWS,
    BROADCAST_BYTES,
    LEAST_PART_ROWS,
    MAX_PIVOT_VALUES,
    MAX_PIVOTS,
    ROUNDING,
    STEP_VALUES,
    Cells,
    _distinct_vectors,
    _grouped,
    _matrix,
    _measure,
    _pivot_gaps,
    _place,
    _slices,
    _spread,
    _vectors,
)
from flockscan.storage import save

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIRS = "source bigint, target bigint, dist2 double"
# Visits handed on at once.
SENT_ROWS = 16_384
SIMILAR = "query_id bigint, neighbour_id bigint, similarity double"


# Blocks of vectors and what visits them


@dataclass
class Blocks:
    """``placed(id, print, vec, cell, block)`` and where its cells lie."""

    placed: DataFrame
    cells: Cells
    norms: np.ndarray


def _cut(vectors: DataFrame, rows: int, dim: int, block_rows: int, least: int) -> Blocks:
    """Deal the rows of ``vectors(id, print, vec)`` into blocks of about ``block_rows``."""
    spark = vectors.sparkSession
    most = max(1, min(MAX_PIVOTS, MAX_PIVOT_VALUES // max(1, dim)))
    count = min(most, max(least, int(2 * rows**0.5)))
    # At most MAX_PIVOTS vectors, drawn by hash; the table is a top-n, not a sort.
    drawn = vectors.orderBy(F.xxhash64("print"), "print").limit(count).select("vec")
    pivots = _matrix(drawn.toArrow()["vec"], dim)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            own = _matrix(batch.column("vec"), dim)
            gaps = _pivot_gaps(own, shared.value)
            cell = gaps.argmin(axis=1)
            made = [cell.astype(np.int32), gaps[np.arange(len(cell)), cell], np.linalg.norm(own, axis=1)]
            names = [*batch.schema.names, "cell", "gap", "norm"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    placed = save(vectors.mapInArrow(assign, f"{kinds}, cell int, gap double, norm double"), "cells").frame
    held, radius, norms = (np.zeros(len(pivots), t) for t in (np.int64, float, float))
    per_cell = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("g"), F.max("norm").alias("m"))
    for row in per_cell.collect():  # one row per pivot
        held[row["cell"]], radius[row["cell"]], norms[row["cell"]] = row["n"], row["g"], row["m"]
    cells = _grouped(pivots, held, radius, block_rows)
    layout = spark.createDataFrame(
        [
            (cell, int(cells.first_block[group]), int(cells.blocks[group]))
            for cell, group in enumerate(cells.group_of_cell())
        ],
        "cell int, first_block int, cell_blocks int",
    )
    block = (F.col("first_block") + F.pmod("print", "cell_blocks")).cast("int")
    dealt = placed.join(F.broadcast(layout), "cell").withColumn("block", block)
    return Blocks(dealt.drop("gap", "norm", "first_block", "cell_blocks"), cells, norms)


def _visits(rows: DataFrame, blocks: Blocks, dim: int, needed: Callable, home: bool) -> tuple[DataFrame, DataFrame]:
    """``(visits, loads)``: a row for each ``visit`` of a vector to a block, and ``(visit, n)``.

    ``needed(vectors, cells)`` marks cells by vector. With ``home`` a vector visits no block
    behind its own, so that two blocks meet once. Visits are not stored, but found twice.
    """
    known = vars(blocks.cells) | {"norms": blocks.norms}
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def choose(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cells = shared.value
        first, size = cells["first_block"], cells["blocks"]
        cell = needed(_matrix(batch.column("vec"), dim), cells) & (cells["rows"] > 0)[None, :]
        visited = np.logical_or.reduceat(cell[:, cells["order"]], cells["starts"], axis=1)
        row, own = np.nonzero(visited)
        times = size[own]
        row = np.repeat(row, times)
        block = np.repeat(first[own], times) + _place(np.repeat(np.arange(len(own)), times))
        if home:
            seen = block <= batch.column("block").to_numpy()[row]
            row, block = row[seen], block[seen]
        return row, block.astype(np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(blocks_of(shared.value)), np.int64)
        for batch in _slices(batches):
            total += np.bincount(choose(batch)[1], minlength=len(total))
        visit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(visit.astype(np.int32)), pa.array(total[visit])], ["visit", "n"])

    def blocks_of(cells: dict) -> int:
        return cells["blocks"].sum()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, block = choose(batch)
            for at in range(0, len(row), SENT_ROWS):
                taken = batch.take(pa.array(row[at : at + SENT_ROWS]))
                visit = pa.array(block[at : at + SENT_ROWS])
                yield pa.RecordBatch.from_arrays([*taken.columns, visit], names=[*batch.schema.names, "visit"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    loads = rows.mapInArrow(count, "visit int, n bigint").groupBy("visit").agg(F.sum("n").alias("n"))
    return rows.mapInArrow(send, f"{kinds}, visit int"), loads


def _met(
    blocks: Blocks, visits: DataFrame, loads: DataFrame, key: str, block_rows: int, search: Callable, schema: str
) -> DataFrame:
    """``search(members, visitors)`` of every block, its visitors in parts of bounded size."""
    cores = visits.sparkSession.sparkContext.defaultParallelism
    counted = save(loads, "loads", total=F.sum("n"))
    # Smaller parts where there would be too few groups to fill all cores.
    even = (counted.metrics["total"] or 0) // (4 * cores)
    part_rows = min(block_rows, max(LEAST_PART_ROWS, even))
    loads = counted.frame.select(F.col("visit").alias("block"), F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    members = blocks.placed.join(loads, "block")
    members = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    part = F.pmod(F.xxhash64(key), "parts").cast("int")
    visitors = visits.withColumnRenamed("block", "home") if "block" in visits.columns else visits
    visitors = visitors.withColumnRenamed("visit", "block").join(loads, "block").withColumn("part", part).drop("parts")
    return members.groupBy("block", "part").cogroup(visitors.groupBy("block", "part")).applyInArrow(search, schema)


# All pairs within a distance


def _close(left: np.ndarray, right: np.ndarray, max_dist2: float):
    """Row numbers and distances of pairs within reach; a product preselects, differences decide."""
    square = np.einsum("ij,ij->i", right, right)
    step = max(1, STEP_VALUES // max(1, len(right)))
    for start in range(0, len(left), step):
        part = left[start : start + step]
        own = np.einsum("ij,ij->i", part, part)
        rough = own[:, None] + square[None, :] - 2.0 * (part @ right.T)
        limit = max_dist2 + ROUNDING * (own + square.max(initial=0.0))
        rows, cols = np.nonzero(rough <= limit[:, None])
        room = max(1, STEP_VALUES // max(1, right.shape[1]))
        for at in range(0, len(rows), room):
            i, j = rows[at : at + room], cols[at : at + room]
            gap = part[i] - right[j]
            dist2 = np.einsum("ij,ij->i", gap, gap)
            near = dist2 <= max_dist2
            yield start + i[near], j[near], dist2[near]


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of a spanning forest: enough to connect what all pairs connect."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    label, index, kept = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return np.sort(np.concatenate([np.empty(0, np.int64), *kept]))
        a, b, index, low, high = a[apart], b[apart], index[apart], low[apart], high[apart]
        # Each root hangs below one smaller root at a time, by one pair.
        _, one = np.unique(high, return_index=True)
        label[high[one]] = low[one]
        kept.append(index[one])
        while (label[label] != label).any():
            label = label[label]


def pairs_within(
    vectors: DataFrame,
    max_dist2: float,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    links_only: bool = False,
) -> DataFrame:
    """``(source, target, dist2)``: every pair of vectors within a squared distance, once.

    Equal vectors are one class with the least of their ids. Pairs of two classes are given
    between these ids, and each other member is paired with its class's id at distance 0:
    together they tell all pairs, without the square of a crowd of copies. ``source`` is the
    smaller id. With ``links_only`` pairs are left out that others connect already.

    Vectors that are NULL as a whole are left out; a missing, NaN or infinite value, or vectors of
    different length, raise. Ids are unique integers.
    """
    base = _vectors(vectors, id_col, vec_col, "id").withColumn("print", F.xxhash64("vec"))
    rows, dim = _measure(base)
    if not rows or max_dist2 < 0:
        return vectors.sparkSession.createDataFrame([], PAIRS)
    classes = base.groupBy("print", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    distinct = save(classes, "classes")
    blocks = _cut(distinct.frame.select("id", "print", "vec"), distinct.rows, dim, block_rows, 1)
    radius = float(max_dist2) ** 0.5

    def needed(own: np.ndarray, cells: dict) -> np.ndarray:
        pivots = cells["pivots"]
        gaps = _pivot_gaps(own, pivots)
        home = gaps.argmin(axis=1)
        home_gap = gaps[np.arange(len(gaps)), home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (gaps**2 - home_gap[:, None] ** 2) / (2.0 * _pivot_gaps(pivots, pivots)[home])
        plane[~np.isfinite(plane)] = 0.0
        nearest = np.maximum(gaps - cells["radius"][None, :], plane)
        # These are not squared, so their error is the square root of the rounding share.
        slack = np.sqrt(ROUNDING) * (gaps.max(axis=1, initial=0.0) + np.abs(own).max(initial=0.0))
        return nearest <= (radius + slack)[:, None]

    def search(members: pa.Table, visitors: pa.Table) -> pa.Table:
        ids, asked = members["id"].to_numpy(), visitors["id"].to_numpy()
        inner = visitors["home"].to_numpy() == (members["block"][0].as_py() if len(ids) else -1)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for q, b, dist2 in _close(_matrix(visitors["vec"], dim), _matrix(members["vec"], dim), max_dist2):
            # Within a block each pair is met from both of its ends.
            once = ~inner[q] | (asked[q] > ids[b])
            out.append((asked[q[once]], ids[b[once]], dist2[once]))
            if links_only:
                x, y, d = (np.concatenate(c) for c in zip(*out, strict=True))
                enough = spanning(x, y)
                out = [(x[enough], y[enough], d[enough])]
        x, y, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([np.minimum(x, y), np.maximum(x, y), d], names=["source", "target", "dist2"])

    placed = blocks.placed.select("id", "vec", "block")
    pairs = _met(blocks, *_visits(placed, blocks, dim, needed, True), "id", block_rows, search, PAIRS)
    crowds = distinct.frame.filter("n > 1").select("print", "vec", F.col("id").alias("source"))
    copies = base.join(crowds, ["print", "vec"]).filter("id <> source")
    return pairs.union(copies.select("source", F.col("id").alias("target"), F.lit(0.0).alias("dist2")))


# The most similar by inner product


def _highest(queries: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int):
    """Row numbers and inner products of the k largest, ties by base id."""
    norms = np.linalg.norm(base, axis=1)
    step = max(1, STEP_VALUES // max(1, len(base)))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        rough = part @ base.T
        if len(base) > k:
            limit = np.partition(rough, len(base) - k, axis=1)[:, len(base) - k]
            limit -= ROUNDING * np.linalg.norm(part, axis=1) * norms.max()
            rows, cols = np.nonzero(rough >= limit[:, None])
        else:
            rows, cols = (x.ravel() for x in np.indices(rough.shape))
        value = np.empty(len(rows))
        room = max(1, STEP_VALUES // max(1, base.shape[1]))
        for at in range(0, len(rows), room):
            some = slice(at, at + room)
            value[some] = np.einsum("ij,ij->i", part[rows[some]], base[cols[some]])
        order = np.lexsort((base_ids[cols], -value, rows))
        rows, cols, value = rows[order], cols[order], value[order]
        keep = _place(rows) < k
        yield start + rows[keep], cols[keep], value[keep]


def _unit(df: DataFrame) -> DataFrame:
    """Vectors of length one; a vector of zeros stays as it is."""
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    return df.withColumn("square", square).withColumn(
        "vec", F.transform("vec", lambda x: F.when(F.col("square") > 0, x / F.sqrt("square")).otherwise(x))
    ).drop("square")


def most_similar(
    queries: DataFrame,
    base: DataFrame | None = None,
    k: int = 4,
    measure: str = "inner",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    exclude_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, neighbour_id, similarity)``: the ``k`` most similar base vectors of each query.

    ``similarity`` is the inner product or, with ``measure="cosine"``, the cosine, which is 0
    for a vector of zeros. Ties are ranked by id. Without ``base`` the queries are searched among
    themselves. Exact; NULL and odd vectors are treated as in ``nearest_neighbours``.
    """
    if measure not in ("inner", "cosine"):
        raise ValueError(f"no measure {measure!r}")
    whole = _vectors(queries if base is None else base, id_col, vec_col, "base_id")
    asked = _vectors(queries, id_col, vec_col, "query_id")
    rows, dim = _measure(whole)
    if base is not None:
        asked_rows, asked_dim = _measure(asked)
        if rows and asked_rows and asked_dim != dim:
            raise ValueError(f"queries have {asked_dim} values, the base has {dim}")
    if not rows:
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, neighbour_id bigint, similarity double")
    wanted = k + 1 if exclude_self else k
    asked, whole = (df.withColumn("vec", F.col("vec").cast("array<double>")) for df in (asked, whole))
    classes = _distinct_vectors(whole, wanted)
    if measure == "cosine":
        asked, classes = _unit(asked), _unit(classes)

    def found(q, b, value, ids, copies) -> tuple:
        """Copies of a vector in order of their ids, less the query itself."""
        starts = copies.offsets.to_numpy()
        times = np.diff(starts)[b]
        at = np.repeat(starts[b], times) + _place(np.repeat(np.arange(len(b)), times))
        q, value, other = np.repeat(ids[q], times), np.repeat(value, times), copies.values.to_numpy()[at]
        if exclude_self:
            apart = q != other
            q, value, other = q[apart], value[apart], other[apart]
        order = np.lexsort((other, -value, q))
        q, value, other = q[order], value[order], other[order]
        keep = _place(q) < k
        return q[keep], other[keep], value[keep]

    names = ["query_id", "neighbour_id", "similarity"]
    if rows * dim * 8 <= broadcast_bytes:
        table = classes.select("ids", "vec").toArrow()
        shared = queries.sparkSession.sparkContext.broadcast((table["ids"].combine_chunks(), _matrix(table["vec"], dim)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            copies, vectors = shared.value
            first = copies.values.to_numpy()[copies.offsets.to_numpy()[:-1]]
            for batch in batches:
                ids = batch.column("query_id").to_numpy()
                for q, b, value in _highest(_matrix(batch.column("vec"), dim), vectors, first, wanted):
                    own = found(q, b, value, ids, copies)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, own)], names=names)

        pairs = _spread(asked, rows).mapInArrow(scan, SIMILAR)
    else:
        stored = save(classes, "distinct")
        blocks = _cut(stored.frame, stored.rows, dim, block_rows, wanted)

        def needed(own: np.ndarray, cells: dict) -> np.ndarray:
            pivots, length = cells["pivots"], np.linalg.norm(own, axis=1)
            products = own @ pivots.T
            # Pivots are base vectors, so the k-th largest product with one is reached.
            reach = np.full(len(own), -np.inf)
            if len(pivots) >= wanted:
                reach = np.partition(products, len(pivots) - wanted, axis=1)[:, len(pivots) - wanted]
            bound = np.minimum(
                length[:, None] * cells["norms"][None, :], products + length[:, None] * cells["radius"][None, :]
            )
            largest = cells["norms"].max(initial=0.0) + cells["radius"].max(initial=0.0)
            return bound >= (reach - np.sqrt(ROUNDING) * length * largest)[:, None]

        def search(members: pa.Table, visitors: pa.Table) -> pa.Table:
            ids, copies = visitors["query_id"].to_numpy(), members["ids"].combine_chunks()
            out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            if len(ids) and len(copies):
                first = copies.values.to_numpy()[copies.offsets.to_numpy()[:-1]]
                vectors = _matrix(members["vec"], dim)
                for q, b, value in _highest(_matrix(visitors["vec"], dim), vectors, first, wanted):
                    out.append(found(q, b, value, ids, copies))
            return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=names)

        visits = _visits(asked, blocks, dim, needed, False)
        pairs = _met(blocks, *visits, "query_id", block_rows, search, SIMILAR)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "neighbour_id", "similarity")
