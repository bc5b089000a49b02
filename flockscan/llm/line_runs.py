"""Line dedup: a suffix array over sequences of line ids, by distributed prefix doubling.

Suffixes of a document's line sequence are ranked by their first line, then by their
first two, four and so on: a rank at twice the depth is the rank of a pair of ranks. Equal
ranks form an interval of the suffix array whose longest common prefix is at least the
depth. Suffixes alone with their rank are dropped at once, as no repeated run starts there.
Every run of at least ``min_lines`` lines that also starts earlier is deleted: such runs
are exactly what the intervals of depth ``min_lines`` cover, so ranks need not go deeper.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockscan.storage import save

MIN_LINES = 3
NO_ID = -(2**63)
PLACE = ("doc", "key", "pos")


def _place() -> Column:
    """Documents in the order of their ids, then of a hash of their text."""
    return F.struct(*PLACE)


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` whose values of ``by`` occur at two places or more, with rank and first place.

    Ranks have gaps, but are in the order of ``by``. The intervals are stored, so that the
    join can split an interval that holds much of the data.
    """
    intervals = rows.groupBy(*by).agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    repeated = intervals.filter(F.col("first") != F.col("last")).drop("last").orderBy(*by)
    numbered = save(repeated.withColumn("rank", F.monotonically_increasing_id()), "intervals").frame
    return save(rows.join(numbered, by).select(*PLACE, "rank", "first"), "suffixes").frame


def suffix_ranks(lines: DataFrame, depth: int) -> DataFrame:
    """``(doc, key, pos, rank, first)`` of all suffixes that share ``depth`` lines with another.

    ``lines(doc, key, pos, id, id2)`` are line sequences. Suffixes with equal ``rank`` are an
    interval of the suffix array with a common prefix of at least ``depth`` lines, ``first``
    is where that prefix stands first. Ranks are in the order of the first ``depth`` ids.
    """
    ranked, reached = _ranked(lines, ["id", "id2"]), 1
    while reached < depth:
        step = min(reached, depth - reached)
        ahead = Window.partitionBy("doc", "key").orderBy("pos").rangeBetween(step, step)
        pairs = ranked.select(*PLACE, F.col("rank").alias("head"), F.first("rank").over(ahead).alias("tail"))
        # Without a tail the text ends, or what follows is unique.
        ranked, reached = _ranked(pairs.filter("tail IS NOT NULL"), ["head", "tail"]), reached + step
    return ranked


def remove_repeated_runs(documents: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept)``: each text without line runs repeated from earlier.

    Lines are parted by ``\\n`` and compared as they are, blank ones too. A line goes if it
    lies in a run of ``min_lines`` or more lines that also starts earlier: in a document
    with a smaller ``doc_id``, or earlier in the same. Runs are judged on the input. The
    other lines are joined again.

    A null text has no lines and stays null; an empty one has one blank line. A null
    ``doc_id`` comes before all others. Rows with equal ids are ordered by a hash of their
    text; rows with equal id and text are one document, and each is given its result.
    Texts of fewer lines stay whole. Other columns are ignored; an empty table gives an
    empty one. Lines are told apart by two 64-bit hashes.
    """
    keyed = documents.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), "text"
    )
    lines = keyed.select("doc", "key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    ids = lines.select(
        *PLACE, F.xxhash64("line").alias("id"), F.xxhash64(F.lit(min_lines), "line").alias("id2")
    )
    ranked = suffix_ranks(ids, min_lines)
    copies = ranked.filter(_place() != F.col("first"))
    removed = copies.select("doc", "key", F.explode(F.sequence("pos", F.col("pos") + min_lines - 1)).alias("gone"))
    removed = removed.groupBy("doc", "key").agg(F.collect_set("gone").alias("gone"))

    # Split below the join, so that a line is taken from a stored array, not from the text again.
    cut = keyed.select("doc", "key", F.split("text", "\n", -1).alias("lines"))
    found = cut.join(removed, ["doc", "key"], "left")
    every = F.col("lines")
    places = F.sequence(F.lit(0), F.size(every) - 1)
    left = F.transform(F.array_except(places, F.col("gone")), lambda i: F.get(every, i))
    whole = F.col("gone").isNull()
    return found.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.when(whole, every).otherwise(left), "\n").alias("kept"),
    )
