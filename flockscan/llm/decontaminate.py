"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` consecutive k-grams of words the one of least hash is
kept as a fingerprint, in documents and benchmark alike. Two texts that share a run of at
least ``window`` words therefore share a fingerprint, wherever the run lies. Fingerprints
meet in an equi-join; each hit is extended to the windows around it, which are compared as
text. Items shorter than a window are one window of their own, fingerprinted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscan.llm.words import (
    ALPHANUMERIC,
    LOWER,
    Words,
    blocks,
    least_places,
    run_hashes,
    split_words,
    text_buffer,
    word_hashes,
)
from flockscan.storage import save

GRAM = 5
# Bits of the table that tells which fingerprints the benchmark has at all. Its size is
# fixed; with a benchmark of many million fingerprints it only lets more rows through.
TABLE_BITS = 23


def _lowered(column: pa.Array) -> tuple[Words, np.ndarray]:
    data, at = text_buffer(column)
    words = split_words(LOWER[data], at, ALPHANUMERIC)
    return words, word_hashes(words)


def _window_prints(
    words: Words, hashes: np.ndarray, size: int, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, fingerprint)`` of each run of ``size`` words within one text.

    The fingerprint of a whole window is its least k-gram, that of a shorter item its own hash.
    """
    runs = run_hashes(hashes, size)
    if size == window > GRAM:
        grams = run_hashes(hashes, GRAM)
        runs = grams[least_places(grams, window - GRAM + 1)]
    starts = np.flatnonzero(words.left()[: len(runs)] >= size)
    return starts, runs[starts]


def _texts(words: Words, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """Words ``low`` to ``high`` (excluded) joined by single spaces, for each pair."""
    whole = words.data.tobytes()
    starts, ends = words.starts, words.ends
    return pa.array(
        [
            b" ".join(whole[s:e] for s, e in zip(starts[a:b], ends[a:b], strict=True)).decode("utf-8", "replace")
            for a, b in zip(low.tolist(), high.tolist(), strict=True)
        ],
        pa.string(),
    )


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """``(item_id, size, print, window)``: every window of every item."""
    for batch in blocks(batches):
        words, hashes = _lowered(batch.column("text"))
        counts, text = words.counts, words.text_of()
        for size in np.unique(np.minimum(counts[counts > 0], window)):
            starts, prints = _window_prints(words, hashes, int(size), window)
            own = np.minimum(counts, window)[text[starts]] == size
            starts, prints = starts[own], prints[own]
            yield pa.record_batch(
                [
                    batch.column("item_id").take(pa.array(text[starts])),
                    pa.array(np.full(len(starts), size), pa.int32()),
                    pa.array(prints.view(np.int64)),
                    _texts(words, starts, starts + size),
                ],
                ["item_id", "size", "print", "window"],
            )


def _document_hits(
    batches: Iterator[pa.RecordBatch], window: int, sizes: list[int], table: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Per text its word count and, as text, the windows whose fingerprint the table knows."""
    known = np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)
    for batch in blocks(batches):
        words, hashes = _lowered(batch.column("text"))
        starts, prints, size = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for n in sizes:
            at, runs = _window_prints(words, hashes, n, window)
            hit = known[runs >> np.uint64(64 - TABLE_BITS)]
            starts.append(at[hit])
            prints.append(runs[hit])
            size.append(np.full(hit.sum(), n))
        starts, prints, size = np.concatenate(starts), np.concatenate(prints), np.concatenate(size)
        owner = words.text_of()[starts]
        order = np.argsort(owner, kind="stable")
        starts, prints, size, owner = starts[order], prints[order], size[order], owner[order]
        hits = pa.StructArray.from_arrays(
            [
                pa.array(size, pa.int32()),
                pa.array(prints.view(np.int64)),
                pa.array(starts - words.first[:-1][owner], pa.int64()),
                _texts(words, starts, starts + size),
            ],
            ["size", "print", "start", "window"],
        )
        ends = np.searchsorted(owner, np.arange(batch.num_rows), "right")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), hits)
        yield pa.record_batch(
            [
                *(batch.column(c) for c in ("row", "doc_id", "text_key")),
                pa.array(words.counts, pa.int64()),
                lists,
            ],
            ["row", "doc_id", "text_key", "n_words", "hits"],
        )


def _known_prints(windows: DataFrame) -> np.ndarray:
    """A bit per value of a fingerprint's upper bits; of fixed size, whatever the benchmark."""
    bit = F.shiftrightunsigned("print", 64 - TABLE_BITS)
    cells = windows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell"))
    rows = cells.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).collect()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for cell, bits in rows:
        table[cell] = bits
    return table


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per document row with what it shares with ``benchmark(item_id, text)``.

    Words are runs of letters and digits, A-Z lower-cased. An item's windows are its runs
    of ``window`` words; an item of fewer words is one window, an item of none has none.
    Returns ``row`` (a number of the row), ``doc_id``, ``text_key`` (XXH64 of the text), ``n_words``, ``n_hit`` (words inside
    an occurrence of a window), ``n_items`` (items with an occurring window) and ``items``
    (their ids as sorted strings).

    A null text has no words. Repeated rows and equal ids each get a row of their own; equal
    item ids count once. Other columns of either table are ignored. Tables may be empty.
    """
    spark = documents.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    made = benchmark.select("item_id", "text").mapInArrow(
        lambda batches: _item_windows(batches, window),
        f"item_id {kind}, size int, print long, window string",
    )
    owners = save(made.distinct(), "windows").frame
    windows = owners.select("size", "print", "window").distinct()
    # At most ``window`` sizes.
    sizes = sorted(r[0] for r in owners.select("size").distinct().collect())
    table = spark.sparkContext.broadcast(_known_prints(windows))

    doc_kind = documents.schema["doc_id"].dataType.simpleString()
    numbered = documents.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        "text",
    )
    scanned = save(
        numbered.mapInArrow(
            lambda batches: _document_hits(batches, window, sizes, table.value),
            f"row long, doc_id {doc_kind}, text_key long, n_words long,"
            " hits array<struct<size:int,print:long,start:long,window:string>>",
        ),
        "document-hits",
    ).frame

    met = scanned.filter(F.size("hits") > 0).select("row", F.inline("hits"))
    met = met.join(windows, ["size", "print", "window"])
    end = F.col("start") + F.col("size")
    earlier = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = end - F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0)))
    hit = met.select("row", F.greatest(covered, F.lit(0)).alias("new"))
    hit = hit.groupBy("row").agg(F.sum("new").alias("n_hit"))
    names = met.select("row", "window").distinct().join(owners.select("window", "item_id"), "window")
    items = names.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return (
        scanned.drop("hits")
        .join(hit, "row", "left")
        .join(items, "row", "left")
        .select(
            "row",
            "doc_id",
            "text_key",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents that share no window with the benchmark; columns as they were.

    Rows with equal ``doc_id`` go or stay by their own text. A null id is kept or
    dropped by its text as well.
    """
    found = find_contamination(documents, benchmark, window)
    dirty = save(found.filter("n_hit > 0").select("doc_id", "text_key").distinct(), "dirty").frame
    own = documents["doc_id"].eqNullSafe(dirty["doc_id"]) & (F.xxhash64(documents["text"]) == dirty["text_key"])
    return documents.join(dirty, own, "left_anti")
