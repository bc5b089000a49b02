"""SimHash near-dedup with pigeonring candidate filtering.

A fingerprint is cut into ``BOXES`` segments set in a ring. If two fingerprints differ in
at most ``distance`` bits, then from some segment on every chain of l consecutive segments
differs in at most l * distance / BOXES bits. So a first segment is equal, and in the
chain after it only a few segments may differ at all: the segments that must be equal
make the keys of an equi-join. What meets on a key has to stay within the budget of every
longer chain, one after the other; the chain around the whole ring is the Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscan.llm.words import (
    BLANK_PARTED,
    LOWER,
    blocks,
    spare_name,
    split_words,
    text_buffer,
)
from flockscan.operators.components import component_roots
from flockscan.storage import save

BITS, BOXES = 64, 8
BOX_BITS = BITS // BOXES
SEED = 42
# Fingerprints of one key compared in one piece; a key with more is dealt out in pairs of pieces.
PIECE = 4_096

# Fingerprints


def _shingles(data: np.ndarray, at: np.ndarray, size: int):
    """``(bytes, starts, ends, counts)``: the space-joined shingles of all texts."""
    words = split_words(LOWER[data], at, BLANK_PARTED)
    length = words.ends - words.starts
    # The words again, each followed by one space.
    new_ends = np.cumsum(length + 1) - 1
    new_starts = new_ends - length
    joined = np.full(int(new_ends[-1]) + 1 if len(new_ends) else 0, 0x20, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[new_ends] = False
    keep = np.zeros(len(words.data) + 1, np.int8)
    keep[words.starts] += 1
    keep[words.ends] -= 1
    joined[inside] = words.data[np.cumsum(keep[:-1], dtype=np.int8).view(bool)]
    counts, left = words.counts, words.left()
    text = words.text_of()
    first = np.flatnonzero(left >= np.minimum(counts, size)[text]) if len(text) else np.empty(0, int)
    # A text of fewer words is one shingle.
    last = first + np.minimum(counts, size)[text[first]] - 1 if len(text) else first
    n = np.bincount(text[first], minlength=len(counts)) if len(text) else np.zeros(len(counts), int)
    return joined.tobytes(), new_starts[first], new_ends[last], n


def _majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half of its hashes; none without hashes."""
    prints = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return prints
    heads = (np.cumsum(counts) - counts)[full]
    for byte in range(8):
        part = hashes.view(np.uint8).reshape(-1, 8)[:, byte]
        for bit in range(8):
            ones = np.add.reduceat((part >> bit) & 1, heads, dtype=np.int64)
            most = (2 * ones > counts[full]).astype(np.uint64)
            prints[full] |= most << np.uint64(8 * byte + bit)
    return prints


def _hashes(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)`` of the shingles of each text, one text after the other."""
    joined, starts, ends, counts = _shingles(*text_buffer(batch.column("text")), size)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)),
        np.uint64,
        len(starts),
    )
    return hashes, counts


def _prints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        prints = pa.array(_majorities(*_hashes(batch, size)).view(np.int64))
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*(batch.column(c) for c in rest), prints], [*rest, "fingerprint"])


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """The columns of ``documents`` but ``text``, and ``fingerprint``, 64 bits as a long."""
    rest = [f for f in documents.schema.fields if f.name not in ("text", "fingerprint")]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["fingerprint long"]
    return documents.select(*(f"`{f.name}`" for f in rest), "text").mapInArrow(
        lambda batches: _prints(batches, shingle), ", ".join(schema)
    )


# Links


def budgets(distance: int) -> list[int]:
    """Bits that chains of 1, 2, ... ``BOXES`` segments may differ in."""
    return [length * distance // BOXES for length in range(1, BOXES + 1)]


def equal_segments(distance: int, chain: int) -> list[tuple[int, ...]]:
    """Sets of segments, counted from a chain's start, of which one set must be equal.

    Every way to spread differing segments over the chain within its budgets leaves one
    of the sets untouched.
    """
    most = budgets(distance)
    touched = most[chain - 1]
    sets = []
    for dirty in combinations(range(chain), touched):
        if all(sum(d < n + 1 for d in dirty) <= most[n] for n in range(chain)):
            sets.append(tuple(i for i in range(chain) if i not in dirty))
    return sets


def _turned(value: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rotated left by ``bits``, less than 64."""
    return (value << bits) | (value >> ((np.uint64(64) - bits) & np.uint64(63)))


def _links(turn: np.ndarray, value: np.ndarray, head: np.ndarray, distance: int):
    """Pairs within ``distance`` bits among neighbours of one run, enough to connect all.

    ``value`` are fingerprints turned so that the chain starts at bit 0, ``head`` marks
    where a run of one key begins. All rows of a run are compared, a shift at a time;
    pairs already connected here are left out.
    """
    n = len(value)
    run_end = np.append(np.flatnonzero(head)[1:], n)[np.cumsum(head) - 1]
    plain = _turned(value, turn)
    nodes, node = np.unique(plain, return_inverse=True)
    parent = np.arange(len(nodes))
    most = budgets(distance)
    chains = [
        (np.uint64((1 << (BOX_BITS * k)) - 1), most[k - 1])
        for k in range(2, BOXES + 1)
        if k == BOXES or most[k - 1] < most[k] or k == 2
    ]

    def follow(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    left, right = [], []
    rows = np.flatnonzero(np.arange(n) + 1 < run_end)
    shift = 1
    while len(rows):
        diff = value[rows] ^ value[rows + shift]
        near = rows
        for mask, bound in chains:
            ok = np.bitwise_count(diff & mask) <= bound
            near, diff = near[ok], diff[ok]
        if len(near):
            a, b = node[near], node[near + shift]
            apart = np.flatnonzero(parent[a] != parent[b])
            merged = False
            for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                x, y = follow(i), follow(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    left.append(i)
                    right.append(j)
                    merged = True
            while merged:
                up = parent[parent]
                merged = bool((up != parent).any())
                parent = up
        shift += 1
        rows = rows[rows + shift < run_end[rows]]
    return nodes[left].view(np.int64), nodes[right].view(np.int64)


LINKS = "a long, b long, key long, turn long, value long, piece int"


def _link_batch(a, b) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.record_batch(
        [pa.array(a), pa.array(b), none, none, none, pa.nulls(len(a), pa.int32())],
        ["a", "b", "key", "turn", "value", "piece"],
    )


def _compare(
    batches: Iterator[pa.RecordBatch], distance: int, piece: int, keys: tuple[str, ...]
) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys, of rows sorted by key.

    A run of over ``piece`` rows is not compared but handed on, numbered by piece.
    """
    names = [*keys, "turn", "value"]
    carried = {c: np.empty(0, np.int64) for c in names}
    large_key, passed = None, 0

    def hand_on(rows):
        nonlocal passed
        n = len(rows["value"])
        number = (passed + np.arange(n)) // piece
        passed += n
        none = pa.nulls(n, pa.int64())
        return pa.record_batch(
            [none, none, *(pa.array(rows[c]) for c in ("key", "turn", "value")), pa.array(number, pa.int32())],
            ["a", "b", "key", "turn", "value", "piece"],
        )

    def settle(rows, final):
        """Compare all complete runs; returns what may go on in the next batch."""
        nonlocal large_key, passed
        n = len(rows["value"])
        if not n:
            return rows, []
        out = []
        head = np.ones(n, bool)
        head[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, n))
        take = lambda part: {c: rows[c][part] for c in names}
        if large_key is not None and rows["key"][0] == large_key:
            out.append(hand_on(take(slice(0, size[0]))))
            at, size = at[1:], size[1:]
        if len(at):
            large_key, passed = None, 0
        open_run = None
        if len(at) and not final:
            open_run, at, size = (at[-1], size[-1]), at[:-1], size[:-1]
        big = size > piece if len(keys) == 1 else np.zeros(len(size), bool)
        for s, m in zip(at[big].tolist(), size[big].tolist(), strict=True):
            passed = 0
            out.append(hand_on(take(slice(s, s + m))))
        passed = 0 if big.any() else passed
        small = np.repeat(at[~big], size[~big]) + (
            np.arange(size[~big].sum()) - np.repeat(np.cumsum(size[~big]) - size[~big], size[~big])
        )
        if len(small):
            turn, value = rows["turn"][small].view(np.uint64), rows["value"][small].view(np.uint64)
            # Comparing turned values needs the same turn, which the key implies.
            out.append(_link_batch(*_links(turn, value, head[small], distance)))
        rest = take(slice(open_run[0], n)) if open_run else take(slice(0, 0))
        if open_run and open_run[1] > piece and len(keys) == 1:
            large_key, passed = rest["key"][0], 0
            out.append(hand_on(rest))
            rest = take(slice(0, 0))
        return rest, out

    for batch in batches:
        rows = {c: np.concatenate([carried[c], np.asarray(batch.column(c), np.int64)]) for c in names}
        carried, out = settle(rows, False)
        yield from out
    _, out = settle(carried, True)
    yield from out
    yield _link_batch(np.empty(0, np.int64), np.empty(0, np.int64))


def near_links(prints: DataFrame, distance: int = 4, chain: int = 5, piece: int = PIECE) -> DataFrame:
    """``(source, target)``: links between distinct ``fingerprint``s that connect all within ``distance``.

    Any two fingerprints that differ in at most ``distance`` bits are joined by a path of
    links, each of which is such a pair. Longer chains make longer and more keys.
    """
    sets = equal_segments(distance, chain)
    # Segment i of the chain holds bits 8 i to 8 i + 7 of the turned fingerprint.
    masks = [sum(((1 << BOX_BITS) - 1) << (BOX_BITS * i) for i in own) for own in sets]
    turns = [BOX_BITS * start for start in range(BOXES)]

    def turned(turn):
        if not turn:
            return F.col("fingerprint")
        low = F.shiftrightunsigned("fingerprint", turn)
        return low.bitwiseOR(F.shiftleft("fingerprint", BITS - turn))

    made = [
        F.struct(
            F.xxhash64(F.lit(turn), F.lit(i), F.col(f"t{turn}").bitwiseAND(F.lit(mask))).alias("key"),
            F.lit(turn).cast("long").alias("turn"),
            F.col(f"t{turn}").alias("value"),
        )
        for turn in turns
        for i, mask in enumerate(masks)
    ]
    distinct = prints.select("fingerprint").filter("fingerprint IS NOT NULL").distinct()
    rows = distinct.select(*(turned(t).alias(f"t{t}") for t in turns)).select(F.inline(F.array(*made)))
    met = rows.repartition("key").sortWithinPartitions("key", "value")
    found = save(met.mapInArrow(lambda b: _compare(b, distance, piece, ("key",)), LINKS), "links").frame

    # Large keys: every two pieces meet in a group of their own.
    large = found.filter("key IS NOT NULL").select("key", "turn", "value", "piece")
    last = large.groupBy("key").agg(F.max("piece").alias("last"))
    others = F.filter(F.sequence(F.lit(0), F.col("last")), lambda p: p != F.col("piece"))
    paired = large.join(last, "key").select("*", F.explode(others).alias("other"))
    paired = paired.withColumns({"low": F.least("piece", "other"), "high": F.greatest("piece", "other")})
    groups = ("key", "low", "high")
    paired = paired.select(*groups, "turn", "value").repartition(*groups).sortWithinPartitions(*groups)
    more = paired.mapInArrow(lambda b: _compare(b, distance, piece, groups), LINKS)
    links = found.filter("key IS NULL").select("a", "b").union(more.select("a", "b"))
    return links.select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target")).distinct()


def near_duplicates(
    documents: DataFrame, shingle: int = 4, distance: int = 4, chain: int = 5, piece: int = PIECE
) -> DataFrame:
    """``(doc_id, text_key, fingerprint, component_id)`` for every row of ``documents``.

    Words are parted by ASCII white space, A-Z lower-cased. Bit b of a fingerprint is 1 if
    over half of the text's shingles have it set in their XXH64 with seed 42. Texts whose
    fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is the
    least ``doc_id`` that links lead to, ``text_key`` the XXH64 of the text.

    A text of fewer words than a shingle is one shingle; a null text, or one without words,
    has fingerprint zero and is linked like any other. Repeated rows stay. A null
    ``doc_id`` is never a component's id unless all ids of the component are null. Other
    columns are ignored; an empty table gives an empty one.
    """
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    marked = save(fingerprints(keyed, shingle), "fingerprints").frame
    roots = component_roots(near_links(marked, distance, chain, piece)).frame
    least = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots.withColumnRenamed("id", "fingerprint"), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id")


def first_of_each(documents: DataFrame, shingle: int = 4, distance: int = 4, chain: int = 5) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates; columns as they were.

    The row with the least ``doc_id`` stays, of equal ids that with the least hash of its
    text; a null id comes last. Of rows equal in both one stays.
    """
    found = save(near_duplicates(documents, shingle, distance, chain), "found").frame
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    # Without any id in a component its fingerprint tells it from others.
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")))
    first = found.groupBy(group.alias("component")).agg(F.min(order).alias("first")).select("first.*")
    first = save(first.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "first").frame
    key = spare_name(documents, "text_key")
    keyed = documents.withColumn(key, F.xxhash64("text"))
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first["_id"]) & (keyed[key] == first["_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*documents.columns)
