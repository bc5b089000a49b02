"""Joins and rankings that stay even when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockscan.storage import save

# Rows of one key that a single task may take before the key is sliced.
ROWS_PER_TASK = 2_000_000
# At most this many keys are sliced, so the table of sliced keys has a fixed bound.
# Any other key then holds less than one part in HOT_KEYS of the rows.
HOT_KEYS = 10_000
HOT_KEY_CHARS = 512


def short_key(df: DataFrame, key: str):
    """True for keys small enough to be broadcast in a list of hot keys."""
    if isinstance(df.schema[key].dataType, T.StringType):
        return F.length(key) <= HOT_KEY_CHARS
    return F.lit(True)


def hot_keys(counts: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """``(key, slices)`` of the largest keys; ``counts`` holds ``(key, n)``."""
    return (
        counts.filter((F.col("n") > rows_per_task) & short_key(counts, key))
        .orderBy(F.desc("n"))
        .limit(HOT_KEYS)
        .select(key, F.ceil(F.col("n") / rows_per_task).cast("int").alias("slices"))
    )


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "inner",
    facts_rows: int | None = None,
    counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    *,
    by_shuffle: bool = False,
) -> DataFrame:
    """Join many rows per key with at most one ``lookup`` row per key.

    Rows of a hot key are dealt over several slices and its one lookup row is
    repeated once per slice; all other keys join as usual. The result equals the
    plain join. ``facts_rows``, when known, skips all this for small inputs. The
    slice comes from a hash of the other columns, so that a task run again after a
    lost executor deals its rows the same way. With ``by_shuffle`` the lookup is never
    broadcast: over many rounds, small tables that pass by the driver add up.
    """
    if by_shuffle:
        lookup = lookup.hint("merge")
    if facts_rows is not None and facts_rows <= rows_per_task:
        return facts.join(lookup, key, how)
    if counts is None:
        counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts, key, rows_per_task))
    others = [c for c in facts.columns if c != key]
    slices = F.coalesce("slices", F.lit(1))
    sliced_facts = (
        facts.join(hot, key, "left")
        .withColumn("slice", F.pmod(F.xxhash64(*others), slices).cast("int"))
        .drop("slices")
    )
    sliced_lookup = (
        lookup.join(hot, key, "left")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("slices")
    )
    if by_shuffle:
        sliced_lookup = sliced_lookup.hint("merge")
    return sliced_facts.join(sliced_lookup, [key, "slice"], how).drop("slice")


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number rows 0, 1, 2, ... in the given order without gathering them in one task.

    A range sort spreads the rows; each gets its place within its partition, and
    the sizes of the earlier partitions (one row per partition) are added.
    """
    spark = df.sparkSession
    placed = save(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    # monotonically_increasing_id keeps the partition above bit 33, the place below.
    part = F.shiftright("place", 33).cast("int")
    sizes = placed.frame.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts, total = [], 0
    for row in sorted(sizes.collect()):
        starts.append((row["part"], total))
        total += row["n"]
    offsets = spark.createDataFrame(starts, "part int, start bigint")
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.frame.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn(name, F.col("start") + within)
        .drop("part", "start", "place")
    )
