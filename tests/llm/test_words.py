from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from flockscan.llm import words as W


def _split(texts, letters=W.BLANK_PARTED):
    return W.split_words(*W.text_buffer(pa.array(texts, pa.string())), letters)


def _strings(words):
    raw = words.data.tobytes()
    return [raw[s:e].decode() for s, e in zip(words.starts, words.ends, strict=True)]


TEXTS = ["one two", "", None, " lead", "trail\n", "é à\tü\r\nx", "   ", "y" * 1000, "end", "x\x1cy z\x0bq"]


def test_words_are_runs_between_ascii_blanks():
    words = _split(TEXTS)
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert list(words.counts) == [len(e) for e in expected]
    assert _strings(words) == [w for e in expected for w in e]


def test_alphanumeric_words_keep_all_beyond_ascii():
    texts = ["a-b c3_d É!", "…x", "[z]"]
    words = _split(texts, W.ALPHANUMERIC)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    assert _strings(words) == [w for t in texts for w in re.findall(pattern, t.replace("É", "É"))]


def test_slices_and_blocks_see_their_own_rows():
    batch = pa.record_batch([pa.array(TEXTS)], ["text"])
    sliced = batch.slice(3, 4)
    assert _strings(W.split_words(*W.text_buffer(sliced.column("text")), W.BLANK_PARTED))[0] == "lead"
    cut = list(W.blocks([batch], limit=12))
    assert sum(b.num_rows for b in cut) == len(TEXTS) and len(cut) > 2
    assert [t for b in cut for t in b.column("text").to_pylist()] == TEXTS
    assert list(W.blocks([batch.slice(0, 0)])) == []


def test_equal_words_have_equal_hashes_and_others_do_not():
    rng = random.Random(3)
    pool = ["".join(rng.choices("abé", k=rng.randint(1, 40))) for _ in range(3000)]
    pool += ["q" * n for n in (7, 8, 9, 16, 17, 255, 256, 257, 5000)]
    hashes = W.word_hashes(_split([" ".join(pool), " ".join(reversed(pool))])).tolist()
    by_word = dict(zip(pool, hashes, strict=False))
    assert len(set(by_word.values())) == len(set(pool))
    assert hashes[len(pool) :] == [by_word[w] for w in reversed(pool)]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 6, 7, 10, 20])
def test_run_hashes_tell_runs_apart(k):
    items = np.random.default_rng(k).integers(0, 3, 400).astype(np.uint64)
    runs = [tuple(items[i : i + k].tolist()) for i in range(len(items) - k + 1)]
    hashes = W.run_hashes(W.mixed(items), k).tolist()
    assert len(set(zip(runs, hashes, strict=True))) == len(set(runs)) == len(set(hashes))
    assert len(W.run_hashes(items[: k - 1], k)) == 0


@pytest.mark.parametrize("width", [1, 2, 5, 6, 15])
def test_least_places_take_the_last_of_equals(width):
    keys = np.random.default_rng(width).integers(0, 4, 300).astype(np.uint64) << np.uint64(40)
    places = W.least_places(keys, width)
    for i, place in enumerate(places):
        window = keys[i : i + width]
        assert place == i + max(np.flatnonzero(window == window.min()))
