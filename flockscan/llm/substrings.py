"""Substring dedup by seed and extend on winnowed anchors.

A window of ``WINDOW`` words is seeded by its anchor, the k-gram of least hash in it, so
equal windows have equal anchors wherever they stand. The windows that share an anchor
are consecutive: they extend the seed both ways as far as a repeat over the length
threshold can reach. Rows meet on their anchors, already freed of windows repeated within
a block of texts; of equal windows all but the first are repeats, and overlapping repeats
merge to the maximal ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockscan.llm.words import (
    BLANK_PARTED,
    binaries,
    blocks,
    least_places,
    mixed,
    run_hashes,
    split_words,
    text_buffer,
    word_hashes,
)
from flockscan.storage import save

WINDOW = 20
GRAM = 6
# Bytes kept of a window's hash; together with its anchor's 64 bits it stands for the text.
HASH_BYTES = 6
# Windows of one anchor a task remembers; what goes beyond is settled window by window.
REMEMBERED = 1 << 20
NO_ID = -(2**63)

ANCHORS = "anchor long, doc_id long, start long, n int, windows binary"
FOUND = "anchor long, window long, doc_id long, start long, n int"


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows of consecutive windows with one anchor, in the words of a block of texts.

    Windows seen earlier in the block come without ``windows``: they are known repeats.
    """
    for batch in blocks(batches):
        batch = batch.sort_by("doc_id")
        words = split_words(*text_buffer(batch.column("text")), BLANK_PARTED)
        hashes = word_hashes(words)
        whole = run_hashes(hashes, window)
        grams = run_hashes(hashes, GRAM)
        place = np.flatnonzero(words.left()[: len(whole)] >= window)
        owner = least_places(grams, window - GRAM + 1)[place]
        _, first = np.unique(whole[place], return_index=True)
        fresh = np.zeros(len(place), bool)
        fresh[first] = True
        text = words.text_of()[place]
        # A row ends where the anchor changes, a window is left out or a text ends.
        head = np.ones(len(place), bool)
        head[1:] = (
            (np.diff(place) != 1)
            | (np.diff(text) != 0)
            | (fresh[1:] != fresh[:-1])
            | (fresh[1:] & (np.diff(owner) != 0))
        )
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(place)))
        # Known repeats need no anchor; a hash of their own deals them out evenly.
        anchor = np.where(fresh[at], grams[owner[at]] if len(at) else at, whole[place[at]])
        kept = whole[place[fresh]]
        low = kept.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
        ids = np.asarray(batch.column("doc_id"), np.int64)
        yield pa.record_batch(
            [
                pa.array(anchor.astype(np.uint64).view(np.int64)),
                pa.array(ids[text[at]]),
                pa.array(place[at] - words.first[:-1][text[at]], pa.int64()),
                pa.array(n, pa.int32()),
                binaries(low, np.cumsum(np.where(fresh[at], n, 0)) * HASH_BYTES),
            ],
            ["anchor", "doc_id", "start", "n", "windows"],
        )


def _intervals(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index of the first, length)`` of runs of consecutive windows of one document."""
    head = np.ones(len(starts), bool)
    head[1:] = (np.diff(starts) != 1) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(head)
    return at, np.diff(np.append(at, len(starts)))


def _found(anchor, window, ids, starts, n) -> pa.RecordBatch:
    """Rows of ``FOUND``; without a window they are repeats, else still to be settled."""
    nothing = pa.nulls(len(ids), pa.int64())
    return pa.record_batch(
        [
            nothing if anchor is None else pa.array(anchor),
            nothing if window is None else pa.array(window),
            pa.array(ids, pa.int64()),
            pa.array(starts, pa.int64()),
            pa.array(n, pa.int32()),
        ],
        ["anchor", "window", "doc_id", "start", "n"],
    )


def _repeats(batches: Iterator[pa.RecordBatch], remembered: int) -> Iterator[pa.RecordBatch]:
    """Windows with an equal one before them, from rows sorted by anchor, document and start.

    Of the anchor at the end of a batch the distinct windows are remembered, at most
    ``remembered`` plus one batch; beyond that they are handed on to be settled elsewhere.
    """
    none = np.empty(0, np.int64)
    last, seen = None, np.empty(0, np.uint64)
    places: list[tuple] = []
    overflowed = False

    def hand_on():
        for v, ids, starts in places:
            yield _found(np.full(len(v), last), v.astype(np.int64), ids, starts, np.ones(len(v), int))

    for batch in batches:
        anchor, ids, starts, n = (
            np.asarray(batch.column(c)) for c in ("anchor", "doc_id", "start", "n")
        )
        cells = batch.column("windows")
        # Of an Arrow binary column: the cells' bytes, one after the other.
        _, ends, data = cells.buffers()
        ends = np.frombuffer(ends, np.int32, len(cells) + 1, cells.offset * 4)
        known = ends[1:] == ends[:-1]
        if known.any():
            yield _found(None, None, ids[known], starts[known], n[known])
        rows = np.flatnonzero(~known)
        if not len(rows):
            continue
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(-1, HASH_BYTES)
        anchor, ids, starts, n = anchor[rows], ids[rows], starts[rows], n[rows]
        final = anchor[-1]
        head = np.ones(len(anchor), bool)
        head[1:] = anchor[1:] != anchor[:-1]
        tail = np.append(head[1:], True)
        # A row alone with its anchor has no repeat; the last anchor may go on.
        used = ~(head & tail) | (anchor == final) | (anchor == last)
        row = np.repeat(np.arange(len(n)), n)
        value = np.zeros((len(raw), 8), np.uint8)
        value[:, :HASH_BYTES] = raw
        value = value.view("<u8").reshape(-1)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        pick = used[row]
        row, value, offset = row[pick], value[pick], offset[pick]
        key = mixed(anchor[row].view(np.uint64)) ^ value
        _, first = np.unique(key, return_index=True)
        fresh = np.zeros(len(key), bool)
        fresh[first] = True
        if last is not None:
            old = anchor[row] == last
            fresh[old] &= ~np.isin(key[old], seen)
        ids, starts = ids[row], starts[row] + offset
        at, length = _intervals(ids[~fresh], starts[~fresh])
        yield _found(None, None, ids[~fresh][at], starts[~fresh][at], length)
        if final != last:
            if overflowed:
                yield from hand_on()
            last, seen, places, overflowed = final, np.empty(0, np.uint64), [], False
        new = fresh & (anchor[row] == final)
        seen = np.concatenate([seen, key[new]])
        places.append((value[new], ids[new], starts[new]))
        if len(seen) > remembered:
            overflowed = True
            yield from hand_on()
            seen, places = np.empty(0, np.uint64), []
    if overflowed:
        yield from hand_on()
    yield _found(None, None, none, none, none)


def repeated_windows(
    documents: DataFrame, window: int = WINDOW, remembered: int = REMEMBERED
) -> DataFrame:
    """``(doc_id, start, n)``: from word ``start`` on, ``n`` windows each have an equal one earlier.

    Earlier means a smaller ``doc_id``, or the same and a smaller start. ``window`` is at
    least ``GRAM`` words.
    """
    seeds = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(
        lambda batches: _anchors(batches, window), ANCHORS
    )
    met = seeds.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    found = save(met.mapInArrow(lambda batches: _repeats(batches, remembered), FOUND), "repeats").frame
    # Only of anchors with more windows than a task remembers; few rows for each window.
    order = Window.partitionBy("anchor", "window").orderBy("doc_id", "start")
    numbered = found.filter("window IS NOT NULL").withColumn("number", F.row_number().over(order))
    settled = numbered.filter("number > 1").union(found.filter("window IS NULL").withColumn("number", F.lit(2)))
    return settled.select("doc_id", "start", "n")


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        n_words, n_removed, kept = [], [], []
        texts, places = batch.column("text"), batch.column("repeats")
        for text, own in zip(texts, places, strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            n_words.append(len(words))
            n_removed.append(0)
            if own.is_valid and len(words):
                part = own.values
                start = np.asarray(part.field("start"))
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, np.minimum(start, len(words)), 1)
                end = start + np.asarray(part.field("n")) + window - 1
                np.add.at(steps, np.minimum(end, len(words)), -1)
                gone = np.cumsum(steps[:-1]) > 0
                n_removed[-1] = int(gone.sum())
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeats(
    documents: DataFrame, window: int = WINDOW, remembered: int = REMEMBERED
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each text without the repeats of earlier ones.

    Words are parted by ASCII white space. Every word inside a run of ``window`` words
    that also starts earlier in the input is removed; ``kept`` has the others joined by one
    space. What is removed is judged on the input, not on what is left of it.

    A null text has no words. Rows with the same ``doc_id`` (nulls among them, which come
    first) are taken as one document: equal runs at the same start are one run, and what
    is repeated in one of the rows is removed at these places of all. Texts shorter than a
    window stay whole. Other columns are ignored; an empty table gives an empty one.
    """
    repeats = repeated_windows(documents, window, remembered)
    each = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("repeats"))
    keyed = documents.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    cut = keyed.join(each, "doc_id", "left").mapInArrow(
        lambda batches: _cut(batches, window),
        "doc_id long, n_words long, n_removed long, kept string",
    )
    return cut.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
