"""Token counts by rank-synchronous merging of byte-level pairs.

Pre-tokens of a batch are held as one ragged array of symbols. In every round each sequence
finds the lowest rank among its pairs of neighbours and replaces all pairs of that rank at
once; a sequence without a rule left is done, and what survives of it is counted. A very
long sequence would need a round for each rank that occurs in it, each over all its
symbols; its pairs wait in buckets by rank instead, so that a round touches its own only.

All pairs of one rank can go at once because a rule uses only symbols that exist before it:
what a merge makes can only meet rules of higher rank.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscan.llm.token_files import _cuts as piece_cuts
from flockscan.llm.words import blocks, release_memory, text_buffer

LIMIT = 1024
NONE = np.iinfo(np.int32).max
# Sequences of more symbols are merged by buckets.
LONG = 4_096
# Pieces of text whose counts a worker remembers, none of them longer than so many bytes.
REMEMBERED, REMEMBERED_BYTES = 500_000, 256


class Merges:
    """The rules of a byte-level BPE: ``made[rank]`` replaces the pair of that rank."""

    def __init__(self, definition: str):
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(definition)
        model, cutter = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space")
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or spec["normalizer"] or not cutter.get("use_regex", True) or any(model.get(k) for k in odd):
            raise ValueError("only byte-level BPE without a normalizer, prefix, suffix or drop-out is counted")
        vocabulary = model["vocab"]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        symbols = np.array([[vocabulary[a], vocabulary[b]] for a, b in pairs], np.int64).reshape(-1, 2)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.base = len(vocabulary) + 1
        born = np.full(max(vocabulary.values(), default=0) + 1, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        if len(pairs) and (born[symbols].max(1) >= np.arange(len(pairs))).any():
            raise ValueError("a rule uses a symbol that only a later rule makes")
        code = symbols[:, 0] * self.base + symbols[:, 1]
        order = np.argsort(code, kind="stable")
        self.codes, self.rank = code[order], order.astype(np.int32)
        # Letters of the byte alphabet, by code point.
        alphabet = ByteLevel.alphabet()
        if not vocabulary.keys() >= set(alphabet):
            raise ValueError("a byte is not in the vocabulary")
        self.letters = np.zeros(max(map(ord, alphabet)) + 1, np.int32)
        for letter in alphabet:
            self.letters[ord(letter)] = vocabulary[letter]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where there is no rule."""
        if not len(self.codes):
            return np.full(len(left), NONE, np.int32)
        code = left.astype(np.int64) * self.base + right
        slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[slot] == code, self.rank[slot], NONE)


def _every_second(follows: np.ndarray) -> np.ndarray:
    """Of pairs that overlap, the first, third, ... of a run; ``follows`` marks all but its first."""
    index = np.arange(len(follows))
    run = np.maximum.accumulate(np.where(follows, 0, index))
    return (index - run) % 2 == 0


def _together(symbols: np.ndarray, counts: np.ndarray, merges: Merges) -> np.ndarray:
    """Survivors of each sequence, all sequences in step."""
    left = counts.copy()
    owner = np.repeat(np.arange(len(counts)), counts)
    rank = np.full(len(symbols), NONE, np.int32)
    rank[:-1] = np.where(owner[:-1] == owner[1:], merges.ranks(symbols[:-1], symbols[1:]), NONE)
    while len(symbols):
        head = np.ones(len(symbols), bool)
        head[1:] = owner[1:] != owner[:-1]
        heads = np.flatnonzero(head)
        size = np.diff(np.append(heads, len(symbols)))
        least = np.repeat(np.minimum.reduceat(rank, heads), size)
        going = least < NONE
        if not going.all():
            symbols, owner, rank, least = (x[going] for x in (symbols, owner, rank, least))
        place = np.flatnonzero(rank == least)
        follows = np.zeros(len(place), bool)
        follows[1:] = np.diff(place) == 1
        place = place[_every_second(follows)]
        symbols[place] = merges.made[rank[place]]
        left -= np.bincount(owner[place], minlength=len(left))
        stay = np.ones(len(symbols), bool)
        stay[place + 1] = False
        symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
        # Every place before took one symbol away.
        place -= np.arange(len(place))
        touched = np.concatenate([place, place[place > 0] - 1])
        rank[touched] = NONE
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[owner[touched] == owner[touched + 1]]
        rank[touched] = merges.ranks(symbols[touched], symbols[touched + 1])
    return left


def _alone(symbols: np.ndarray, merges: Merges) -> int:
    """Survivors of one long sequence: its pairs wait in buckets by rank."""
    n = left = len(symbols)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    rank = np.full(n, NONE, np.int32)
    buckets: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def put(places):
        """Rank the pairs that begin at ``places`` and let them wait."""
        rank[places] = NONE
        places = places[after[places] < n]
        own = merges.ranks(symbols[places], symbols[after[places]])
        rank[places] = own
        some = own < NONE
        places, own = places[some], own[some]
        order = np.argsort(own, kind="stable")
        places, own = places[order], own[order]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
        for r, part in zip(own[at].tolist(), np.split(places, at[1:]), strict=False):
            if r not in buckets:
                heapq.heappush(waiting, r)
            buckets.setdefault(r, []).append(part)

    put(np.arange(n, dtype=np.int32))
    while waiting:
        least = heapq.heappop(waiting)
        place = np.unique(np.concatenate(buckets.pop(least)))
        # A pair that another merge has changed since waits elsewhere or not at all.
        place = place[rank[place] == least]
        if not len(place):
            continue
        follows = np.zeros(len(place), bool)
        follows[1:] = after[place[:-1]] == place[1:]
        place = place[_every_second(follows)]
        gone = after[place]
        symbols[place] = merges.made[least]
        rank[gone] = NONE
        after[place] = after[gone]
        before[after[place]] = place
        left -= len(place)
        ahead = before[place]
        put(np.unique(np.concatenate([place, ahead[ahead >= 0]])))
    return left


def surviving(symbols: np.ndarray, counts: np.ndarray, merges: Merges, long: int = LONG) -> np.ndarray:
    """How many symbols are left of each sequence when all rules are applied.

    ``symbols`` holds sequences of ``counts`` symbols, one after the other.
    """
    left = counts.astype(np.int64)
    ends = np.cumsum(left)
    big = np.flatnonzero(left > long)
    for i in big.tolist():
        left[i] = _alone(symbols[ends[i] - counts[i] : ends[i]].copy(), merges)
    small = np.flatnonzero(counts <= long)
    own = symbols if not len(big) else symbols[np.repeat(counts <= long, counts)]
    left[small] = _together(own.copy(), counts[small].astype(np.int64), merges)
    return left


class Counter:
    """Counts tokens of texts, merging each distinct piece of text once."""

    def __init__(self, definition: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.merges = Merges(definition)
        self.pre_tokens = Tokenizer.from_str(definition).pre_tokenizer.pre_tokenize_str
        special = json.loads(definition)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("special tokens that take in what is around them are not counted")
        # The longest of those that begin at a place, as the library finds them.
        strings = sorted((t["content"].encode() for t in special if t["content"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        self.remembered = remembered
        self.known: dict[bytes, int] = {}

    def _merged(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece."""
        parts, owner = [], []
        for i, piece in enumerate(pieces):
            own = [letters for letters, _ in self.pre_tokens(piece.decode())]
            parts += own
            owner += [i] * len(own)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        letters = np.frombuffer("".join(parts).encode("utf-16-le"), "<u2")
        left = surviving(self.merges.letters[letters], counts, self.merges)
        return np.bincount(np.array(owner, np.int64), left, len(pieces)).astype(np.int64)

    def _specials(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``(begin, end)`` of the special strings, none across two texts."""
        raw = data.tobytes()
        if self.special is None or not self.special.search(raw):
            return np.empty((0, 2), np.int64)
        ranges = []
        for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            ranges += [m.span() for m in self.special.finditer(raw, low, high)]
        return np.array(ranges, np.int64).reshape(-1, 2)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of tokens of each text."""
        special = self._specials(data, at)
        # What is around a special string is cut as if it were a text.
        bounds = np.sort(np.concatenate([at, special.reshape(-1)])) if len(special) else at
        starts, _ = piece_cuts(data, bounds)
        if not len(starts):
            return np.zeros(len(at) - 1, np.int64)
        large = len(data) >= 1 << 31
        offsets = np.append(starts, len(data)).astype(np.int64 if large else np.int32)
        kind = pa.large_binary() if large else pa.binary()
        pieces = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        encoded = pieces.dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        if len(self.known) > self.remembered:
            self.known.clear()
        counts = np.fromiter((self.known.get(p, -1) for p in distinct), np.int64, len(distinct))
        new = np.flatnonzero(counts < 0)
        if len(new):
            fresh = [distinct[i] for i in new.tolist()]
            counts[new] = self._merged(fresh)
            self.known.update(
                (p, n) for p, n in zip(fresh, counts[new].tolist(), strict=True) if len(p) <= REMEMBERED_BYTES
            )
        tokens = counts[np.asarray(encoded.indices)]
        if len(special):
            # The pieces of a special string count as one token, that of its begin.
            within = np.searchsorted(special[:, 0], starts, "right") - 1
            inside = (within >= 0) & (starts < special[np.maximum(within, 0), 1])
            tokens[inside] = 0
            tokens[np.searchsorted(starts, special[:, 0])] = 1
        total = np.concatenate([[0], np.cumsum(tokens)])
        return np.diff(total[np.searchsorted(starts, at)])


def _counter(definition: str) -> Counter:
    """One for all tasks of a worker, in a module of its own, as shipped functions are made anew."""
    kept = sys.modules.setdefault("flockscan_counts", types.ModuleType("flockscan_counts")).__dict__
    if kept.get("definition") != definition:
        kept.update(definition=definition, counter=Counter(definition))
    return kept["counter"]


def _count(batches: Iterator[pa.RecordBatch], definition: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(definition)
    for batch in blocks(batches):
        data, at = text_buffer(batch.column("text"))
        columns = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(counter(data, at))]
        yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_tokens"])
    release_memory()


def count_tokens(documents: DataFrame, definition: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``documents(doc_id, text)``.

    ``definition`` is the JSON text of a byte-level BPE of the tokenizers library; it is sent
    to the tasks, so its file need only be readable by the driver. ``n_tokens`` is what the
    library gives for the whole text without begin, end or padding; a special string in
    the text is one token, as by the library's default. ``n_bytes`` are those of UTF-8.

    A null or empty text has no bytes and no tokens. Repeated rows and null ids each give
    their row. Other columns are ignored; an empty table gives an empty one.
    """
    shared = documents.sparkSession.sparkContext.broadcast(definition)
    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = documents.select("doc_id", "text").mapInArrow(
        lambda batches: _count(batches, shared.value), f"doc_id {kind}, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
