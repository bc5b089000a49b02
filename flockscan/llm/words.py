"""Words of whole Arrow text columns as NumPy arrays, for use inside Arrow batch functions.

All texts of a block are handled at once: words are byte ranges of the column's own
buffer, and every word, run of words and window gets a 64-bit hash without a Python
loop over words. Memory is bounded by the block, a few megabytes of text or one text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

# Text bytes handled at once; a single longer text is a block of its own.
BLOCK_BYTES = 4 << 20
# Words of more bytes are hashed one by one, so that no loop depends on the longest word.
LONG_WORD = 256

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
HALF = np.uint64(32)

# Words parted by ASCII white space only: every byte but \x20 and \x09-\x0D.
BLANK_PARTED = np.ones(256, bool)
BLANK_PARTED[[0x20, *range(0x09, 0x0E)]] = False
# Words of letters and digits: every byte but \x00-\x2F, \x3A-\x60, \x7B-\x7F.
ALPHANUMERIC = np.ones(256, bool)
ALPHANUMERIC[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
# A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a text column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    wide = np.int64 if large else np.int32
    n, skip = len(column), column.offset
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, wide, n + 1, skip * np.dtype(wide).itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def blocks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        _, at = text_buffer(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def release_memory() -> None:
    """Hand freed memory back to the system, as workers live on after their task."""
    pa.default_memory_pool().release_unused()
    # Of the C library here; others give memory back by themselves or not at all.
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@dataclass
class Words:
    """Words of some texts: byte ranges of ``data``; text i owns words first[i]:first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """For each word how many words its text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def split_words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> Words:
    """Words, the longest runs of bytes marked in ``letters``, none across two texts."""
    inside = letters[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole 64 bits; a bijection."""
    h = (h ^ (h >> HALF)) * MIX
    h ^= h >> np.uint64(29)
    h *= ODD
    return h ^ (h >> HALF)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, alike in every batch and task."""
    length = words.ends - words.starts
    # Any eight bytes from any place on, little-endian; the end is padded.
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(words.data) + 1, "<u8", padded, strides=(1,))
    h = mixed(length.astype(np.uint64) + ODD)
    todo, done = np.flatnonzero((length > 0) & (length <= LONG_WORD)), 0
    while len(todo):
        more = length[todo] - done
        piece = eights[words.starts[todo] + done]
        cut = more < 8
        piece[cut] &= (np.uint64(1) << (more[cut] * 8).astype(np.uint64)) - np.uint64(1)
        h[todo] = mixed(h[todo] ^ (piece * ODD))
        todo, done = todo[more > 8], done + 8
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(words.data[words.starts[i] : words.ends[i]].tobytes())
    return h


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive items; the last k - 1 places are absent.

    A polynomial in a fixed odd number, built up by doubling the length of the run.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd, length, result, covered = int(ODD), 1, None, 0
    step = h.astype(np.uint64)
    while True:
        power = np.uint64(odd)
        if k & length:
            part = step[covered : covered + n]
            result = part.copy() if result is None else result * power + part
            covered += length
        if covered == k:
            return mixed(result)
        step = step[:-length] * power + step[length:]
        odd, length = odd * odd % 2**64, length * 2


def least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` keys the place of its least key, the last of equals.

    Depends on the keys in the window alone: equal windows pick alike. Keys are compared
    by their upper 40 bits, ties by place, so at most 2^24 keys are handled at once.
    """
    n = len(keys) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if len(keys) > 1 << 24:
        half = len(keys) // 2
        head = least_places(keys[: half + width - 1], width)
        return np.concatenate([head, least_places(keys[half:], width) + half])
    low = np.uint64((1 << 24) - 1)
    least = (keys & ~low) | (low - np.arange(len(keys), dtype=np.uint64))
    length = 1
    while length * 2 <= width:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    if length < width:
        least = np.minimum(least[:n], least[width - length : width - length + n])
    return (low - (least[:n] & low)).astype(np.int64)


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose cells are the consecutive pieces of ``data`` up to each end."""
    at = np.concatenate([[0], ends]).astype(np.int32)
    raw = np.ascontiguousarray(data).view(np.uint8).reshape(-1)
    return pa.Array.from_buffers(
        pa.binary(), len(ends), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())]
    )
