"""Token ids in files compressed by Re-Pair grammars.

Documents are range-sorted by id. Consecutive documents of a partition make a shard. In
each shard the most frequent pairs of neighbouring symbols are replaced by nonterminals,
again and again until no pair occurs LEAST_COUNT times; a shard's row holds the rules, the
length each nonterminal expands to and the remaining symbols of every document. With the
lengths any span of a document can be decoded without expanding what lies before it.
"""

from __future__ import annotations

import itertools
import os
import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscan.llm.words import Words, blocks, release_memory, text_buffer, word_hashes

END_ID = 0
SHARD_BYTES = 1 << 20
# How often a pair must occur to be replaced: a rule takes 12 bytes, a symbol 2 or 4.
LEAST_COUNT = 24
# Cells that pairs are counted in, where there are more than a few.
COUNTERS, FEW = 1 << 16, 1 << 15
# Ids of pieces of text that a worker remembers, cells to find them by, and pieces handed to
# the library at once.
REMEMBERED, CELLS = 1 << 23, 1 << 21
LOW = (1 << 32) - 1
PIECES = 2_048

# Encoding


def _blank_end(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether two bytes, ``before`` and ``last``, can end white space."""
    wide = (before == 0xC2) | (before == 0x80) | (before == 0x81) | (before == 0x9A)
    return (last <= 0x20) | ((last >= 0x80) & wide)


def _runs(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(begins - before, lengths) + np.arange(lengths.sum())


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, first)``: pieces of the texts that are encoded alike wherever they stand.

    A piece begins at a space after a byte that can't end white space: no token reaches
    from a word into the space behind it, so encoding the pieces encodes the text.
    """
    n = len(data)
    head = np.zeros(n, bool)
    if n > 2:
        head[2:] = (data[2:] == 0x20) & ~_blank_end(data[1:-1], data[:-2])
    filled = at[:-1][at[:-1] < at[1:]]
    head[filled] = True
    starts = np.flatnonzero(head)
    return starts, np.searchsorted(starts, at)


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of hashes."""
    last = np.uint64(CELLS - 1)
    return (hashes & last).astype(np.int64), (hashes >> np.uint64(32) & last).astype(np.int64)


class Encoder:
    """Encodes texts with a tokenizer, each distinct piece of text once."""

    def __init__(self, definition: str, remembered: int = REMEMBERED):
        # One thread: a task has one core, and each thread would hold memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.remembered = remembered
        # Tokens that begin with a space, which byte-level vocabularies spell as U+0120.
        spelled = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(spelled.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in spelled.items() if token.startswith("\u0120")]] = True
        self.forget()

    def forget(self, ids: int = 0) -> None:
        """Start anew, with room for ``ids`` ids at least."""
        # A piece has two cells, by the lower and the upper half of its hash; 0 is an empty cell.
        self.keys = np.zeros(CELLS, np.uint64)
        # Where a piece's ids begin, above bit 32, and how many they are.
        self.places = np.zeros(CELLS, np.int64)
        self.ids = np.empty(max(self.remembered, ids), np.int32)
        self.filled = 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of texts; a batch keeps the library's per-call cost low."""
        found, lengths = [np.empty(0, np.int32)], []
        for low in range(0, len(texts), PIECES):
            encoded = self.tokenizer.encode_batch_fast(texts[low : low + PIECES], add_special_tokens=False)
            ids = [e.ids for e in encoded]
            lengths += map(len, ids)
            found.append(np.fromiter(itertools.chain.from_iterable(ids), np.int32))
        return np.concatenate(found), np.array(lengths, np.int64)

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of pieces that hold one space each, which they begin with.

        As no token reaches over the start of a piece, many are encoded as one text, and each
        begins with the one token that begins with its space. Where a special token takes
        spaces away, there are fewer such tokens, and pieces are encoded one by one.
        """
        found, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for low in range(0, len(starts), PIECES):
            part = slice(low, low + PIECES)
            text = data[_runs(starts[part], ends[part] - starts[part])].tobytes().decode()
            ids, _ = self._encode([text])
            heads = np.flatnonzero(self.spaced[ids])
            n = np.diff(np.append(heads, len(ids)))
            if len(heads) != len(starts[part]):
                ids, n = self._encode(_strings(data, starts[part], ends[part]))
            found.append(ids)
            lengths.append(n)
        return np.concatenate(found), np.concatenate(lengths)

    def _encode_pieces(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, begins, lengths)`` of pieces."""
        blanks = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(data == 0x20, out=blanks[1:])
        plain = self.spaced.any() & (data[starts] == 0x20) & (blanks[ends] - blanks[starts] == 1)
        plain &= (ends - starts > 1) & ~_blank_end(data[ends - 1], data[ends - 2])
        words, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, n = self._encode_words(data, starts[words], ends[words])
        more, m = self._encode(_strings(data, starts[others], ends[others]))
        lengths = np.empty(len(starts), np.int64)
        begins = np.empty(len(starts), np.int64)
        lengths[words], lengths[others] = n, m
        begins[words], begins[others] = np.cumsum(n) - n, len(ids) + np.cumsum(m) - m
        return np.concatenate([ids, more]), begins, lengths

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of all texts, one after the other."""
        starts, first = _cuts(data, at)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(at) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        hashes = word_hashes(Words(data, starts, ends, first))
        hashes[hashes == 0] = 1
        cell, other = _cells(hashes)
        cell = np.where(self.keys[cell] == hashes, cell, other)
        place = self.places[cell]
        unknown = np.flatnonzero(self.keys[cell] != hashes)
        if len(unknown):
            new, where, which = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            where = unknown[where]
            ids, begins, lengths = self._encode_pieces(data, starts[where], ends[where])
            if self.filled + len(ids) > len(self.ids):
                if self.filled:
                    self.forget()
                    return self(data, at)
                self.forget(len(ids))
            self.ids[self.filled : self.filled + len(ids)] = ids
            fresh = begins + self.filled << 32 | lengths
            self.filled += len(ids)
            place[unknown] = fresh[which]
            # The first cell if it is empty, else the second, whatever it holds.
            cell, other = _cells(new)
            cell = np.where(self.keys[cell] == 0, cell, other)
            self.keys[cell] = new
            self.places[cell] = fresh
        begin, length = place >> 32, place & LOW
        total = np.concatenate([[0], np.cumsum(length)])
        return self.ids[_runs(begin, length)], np.diff(total[first])


def _encoder(definition: str) -> Encoder:
    """One for all tasks of a worker, so that what it remembers is of use to the next task.

    It is kept in a module of its own, as functions shipped with a plan are made anew.
    """
    kept = sys.modules.setdefault("flockscan_kept", types.ModuleType("flockscan_kept")).__dict__
    if kept.get("definition") != definition:
        kept.update(definition=definition, encoder=Encoder(definition))
    return kept["encoder"]


def _ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` behind each document."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


# Grammar


@dataclass
class Grammar:
    """Rules: nonterminal ``first + i`` stands for the two symbols ``pairs[i]``.

    ``lengths[i]`` is the number of ids it expands to. A rule uses earlier ones only.
    """

    first: int
    pairs: np.ndarray
    lengths: np.ndarray

    def expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the expansions of all rules, one after the other."""
        ends = np.cumsum(self.lengths)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        begins, done = ends - self.lengths, np.zeros(len(ends), bool)
        todo = np.arange(len(ends))
        while len(todo):
            # Rules whose two symbols are ids or expanded already.
            rule = self.pairs[todo] - self.first
            ready = ((rule < 0) | done[np.maximum(rule, 0)]).all(1)
            now, todo, rule = todo[ready], todo[~ready], rule[ready]
            at = begins[now]
            for side in (0, 1):
                own = rule[:, side]
                plain = own < 0
                ids[at[plain]] = own[plain] + self.first
                inner = own[~plain]
                ids[_runs(at[~plain], self.lengths[inner])] = ids[_runs(begins[inner], self.lengths[inner])]
                at = at + np.where(plain, 1, self.lengths[np.maximum(own, 0)])
            done[now] = True
        return ids, ends

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol expands to."""
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        size[rule] = self.lengths[symbols[rule] - self.first]
        return size

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a sequence of symbols."""
        ids, ends = self.expanded()
        size = self.sizes(symbols)
        total = np.cumsum(size)
        out = np.repeat(symbols, size)
        long = np.flatnonzero(size > 1)
        rule = symbols[long] - self.first
        n = size[long]
        out[_runs(total[long] - n, n)] = ids[_runs(ends[rule] - n, n)]
        return out

    def decode_span(self, symbols: np.ndarray, low: int, high: int) -> np.ndarray:
        """Ids ``low`` to ``high`` (excluded), expanding only the symbols that reach into them."""
        ends = np.cumsum(self.sizes(symbols))
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.decode(symbols[a:b])[low - skipped : high - skipped]


def re_pair(
    ids: np.ndarray, counts: np.ndarray, first: int, least_count: int = LEAST_COUNT
) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """``(grammar, symbols, counts)`` of documents of ``counts`` ids each.

    Pairs that occur ``least_count`` times are replaced, the most frequent first, until there
    are none. Where frequent pairs overlap, the more frequent one is replaced and the other
    waits for the next round, so that a round replaces many pairs and the most frequent one
    everywhere. What is rare stays rare until a neighbour changes, so later rounds look only
    at frequent pairs and at what stands beside a replacement. No pair reaches over the end
    of a document.
    """
    n, rare = len(ids), np.iinfo(np.int32).max
    symbols = ids.astype(np.int32)
    # Places of the symbols before and after; n stands for none.
    before, after = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
    before[0], after[n] = n, n
    last = np.ones(n + 1, bool)
    last[:n] = False
    last[np.cumsum(counts) - 1] = True
    alive, open_ = np.ones(n, bool), ~last[:n]
    rank_at = np.full(n + 1, rare, np.int32)
    grammar = Grammar(first, np.empty((0, 2), np.int64), np.empty(0, np.int64))
    while True:
        place = np.flatnonzero(open_)
        a, b = symbols[place], symbols[after[place]]
        # A pair of a rare cell is rare; the cells spare the sort most of them.
        if len(place) > FEW:
            cell = (a * np.int32(40_503) + b) & np.int32(COUNTERS - 1)
            common = (np.bincount(cell, minlength=COUNTERS) >= least_count)[cell]
            open_[place[np.flatnonzero(~common)]] = False
            common = np.flatnonzero(common)
            place, a, b = place[common], a[common], b[common]
        code = a.astype(np.int64) << 32 | b
        # Of a run of one symbol every second place counts.
        odd = np.zeros(len(place), bool)
        if len(place):
            head = np.ones(len(place), bool)
            head[1:] = (code[1:] != code[:-1]) | (place[1:] != after[place[:-1]])
            if not head.all():
                index = np.arange(len(place), dtype=np.int32)
                odd = ((index - np.maximum.accumulate(np.where(head, index, 0))) & 1).astype(bool)
        pairs, which = np.unique(code, return_inverse=True)
        times = np.bincount(which[~odd], minlength=len(pairs))
        often = np.flatnonzero(times >= least_count)
        if not len(often):
            break
        open_[place[np.flatnonzero((times < least_count)[which])]] = False
        rank = np.full(len(pairs), rare, np.int32)
        often = often[np.argsort(-times[often], kind="stable")]
        rank[often] = np.arange(len(often))
        own = np.where(odd, rare, rank[which])
        rank_at[place] = own
        chosen = np.flatnonzero((own < rank_at[after[place]]) & (own < rank_at[before[place]]))
        rank_at[place] = rare
        place, own = place[chosen], own[chosen]
        taken = np.bincount(own, minlength=len(often)) >= least_count
        new = np.where(taken, first + len(grammar.pairs) + np.cumsum(taken) - 1, 0)
        replaced = np.flatnonzero(taken[own])
        place, own = place[replaced], own[replaced]
        pair = pairs[often[taken]]
        pair = np.stack([pair >> 32, pair & 0xFFFFFFFF], 1)
        size = grammar.sizes(pair.reshape(-1)).reshape(-1, 2).sum(1)
        grammar = Grammar(first, np.concatenate([grammar.pairs, pair]), np.concatenate([grammar.lengths, size]))
        gone = after[place]
        symbols[place] = new[own]
        last[place] = last[gone]
        alive[gone] = open_[gone] = False
        after[place] = after[gone]
        before[after[gone]] = place
        before[n] = n
        # What stands beside a replacement may be frequent now.
        open_[place] = ~last[place]
        left = before[place]
        left = left[~last[left]]
        open_[left] = True
    ends = np.flatnonzero(last[:n][alive]) + 1
    return grammar, symbols[alive].astype(np.int32), np.diff(ends, prepend=0)


# Files

SHARD = (
    "part int, shard int, start long, n_tokens long, first_rule int, doc_ids array<long>,"
    " token_counts array<long>, symbol_counts array<long>, rules binary, symbols binary"
)


def _shards(batches: Iterator[pa.RecordBatch], definition: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(definition)
    first = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
    part, start = TaskContext.get().partitionId(), 0
    for shard, batch in enumerate(blocks(batches, limit=SHARD_BYTES)):
        ids, counts = _ended(*encoder(*text_buffer(batch.column("text"))), end_id)
        grammar, symbols, left = re_pair(ids, counts, first)
        rules = np.column_stack([grammar.pairs, grammar.lengths]).astype("<u4")
        width = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "part": part,
                    "shard": shard,
                    "start": start,
                    "n_tokens": len(ids),
                    "first_rule": first,
                    "doc_ids": batch.column("doc_id").to_pylist(),
                    "token_counts": counts.tolist(),
                    "symbol_counts": left.tolist(),
                    "rules": rules.tobytes(),
                    "symbols": symbols.astype(width).tobytes(),
                }
            ],
            pa.schema(
                [
                    ("part", pa.int32()),
                    ("shard", pa.int32()),
                    ("start", pa.int64()),
                    ("n_tokens", pa.int64()),
                    ("first_rule", pa.int32()),
                    ("doc_ids", pa.list_(pa.int64())),
                    ("token_counts", pa.list_(pa.int64())),
                    ("symbol_counts", pa.list_(pa.int64())),
                    ("rules", pa.binary()),
                    ("symbols", pa.binary()),
                ]
            ),
        )
        start += int(counts.sum())
        del ids, counts, grammar, symbols, left, rules
        release_memory()


def write_token_files(documents: DataFrame, path: str, definition: str, end_id: int = END_ID) -> None:
    """Write the ids of all ``text``s in ascending ``doc_id`` order to a folder of shards.

    ``definition`` is the JSON text of a tokenizer of the tokenizers library; it is sent to
    the tasks, so its file need only be readable by the driver. Each document's ids are
    followed by ``end_id``. A null text counts as empty. Rows with a null ``doc_id`` come
    first; rows with the same id follow each other, ordered by a hash of their text.
    """
    shared = documents.sparkSession.sparkContext.broadcast(definition)
    ordered = documents.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(
        lambda batches: _shards(batches, shared.value, end_id), SHARD
    ).write.parquet(path)


def shard_grammar(row: dict) -> tuple[Grammar, np.ndarray]:
    """``(grammar, symbols)`` of a shard's row."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 3).astype(np.int64)
    width = "<u2" if row["first_rule"] + len(rules) <= 1 << 16 else "<u4"
    return Grammar(row["first_rule"], rules[:, :2], rules[:, 2]), np.frombuffer(row["symbols"], width).astype(np.int32)


def _read(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            grammar, symbols = shard_grammar(row)
            ids = grammar.decode(symbols).astype("<u4")
            counts = np.array(row["token_counts"], np.int64)
            ends = np.cumsum(counts)
            pieces = [ids[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            columns = [
                pa.array(np.full(len(counts), row["part"]), pa.int32()),
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(row["start"] + ends - counts),
                pa.array(counts),
                pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
            ]
            names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                at = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns.append(pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int64))))
                names.append("ids")
            yield pa.record_batch(columns, names)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files.

    ``start`` counts the ids of all documents before it in the whole folder; ``ids`` adds
    the ids themselves.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    # One row per partition that was written.
    totals = sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_tokens")).collect()))
    bases, before = [], 0
    for part, n in totals:
        bases.append((part, before))
        before += n
    more = ", ids array<long>" if with_ids else ""
    found = shards.mapInArrow(
        lambda batches: _read(batches, with_ids),
        f"part int, doc_id long, start long, n_tokens long, ids_crc32 long{more}",
    )
    base = spark.createDataFrame(bases, "part int, base long")
    return found.join(F.broadcast(base), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")
