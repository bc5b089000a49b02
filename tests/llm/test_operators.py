"""Each operator on small tables: its method's own parts, odd rows and empty tables."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flockscan.llm import decontaminate, line_runs, mixing, perplexity, quality, simhash, substrings, token_files, urls, warc
from flockscan.storage import new_path
from helpers import components

# Tables

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `key` string, `row` int, start int"


def long_text(words: int, seed: int = 1) -> str:
    value, out = seed, []
    for _ in range(words):
        value = (value * 1103515245 + 12345) % 2**31
        out.append(f"w{value % 99991}")
    return " ".join(out)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    plain = "A clean sentence of the kind that is in every text and that is not too short. " * 2
    lines = "first line\nsecond line\nthird line\nfourth line"
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "a"),
        (4, long_text(60_000), "en", "b"),
        (5, "z" * 200_000, "en", None),
        (6, plain, "en", "b"),
        (6, plain, "en", "b"),
        (6, plain + "other", "fr", "b"),
        (7, long_text(90, 5), "en", "b"),
        (8, "before " + long_text(90, 5) + " after", "en", "c"),
        (9, lines, "en", "c"),
        (10, lines + "\nfifth", "en", "c"),
        (11, lines + "\n\n\n" + lines, "en", "c"),
        (None, plain, "en", "b"),
        (None, None, None, None),
        (12, "one two", "de", "d"),
        (13, "one two", "de", "d"),
        (14, "été <|endoftext|> a  b c", "fr", "d"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "k", 7, 0) for i, t, lang, s in texts]


@pytest.fixture(scope="module")
def odd_documents(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash


def test_segments_cover_every_way_to_differ():
    for distance, chain in ((4, 5), (3, 5), (6, 5), (4, 3)):
        sets = simhash.equal_segments(distance, chain)
        most = simhash.budgets(distance)
        for dirty in range(1 << chain):
            places = [i for i in range(chain) if dirty >> i & 1]
            within = all(sum(p <= n for p in places) <= most[n] for n in range(chain))
            if within:
                assert any(not set(own) & set(places) for own in sets)


@pytest.mark.parametrize(("distance", "piece"), [(4, 4096), (4, 8), (6, 50), (1, 4096)])
def test_links_connect_all_near_fingerprints(spark, distance, piece):
    rng = np.random.default_rng(distance)
    values = set()
    for center in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(60):
            value = int(center)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                value ^= 1 << int(bit)
            values.add(value)
    values = sorted(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in [*signed, *signed[:5], None]], "fingerprint bigint")
    links = {tuple(r) for r in simhash.near_links(rows, distance, piece=piece).collect()}
    number = {v: i for i, v in enumerate(signed)}
    assert all((values[number[a]] ^ values[number[b]]).bit_count() <= distance for a, b in links)
    root = list(range(len(values)))

    def follow(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = follow(number[a]), follow(number[b])
        root[max(x, y)] = min(x, y)
    assert [follow(i) for i in root] == components(values, distance)


def test_near_duplicates_on_odd_rows(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == 18
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert {by_id[i]["fingerprint"] for i in (1, 2, 3)} == {0}
    assert {by_id[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert by_id[13]["component_id"] == 12
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {1, 6}
    assert simhash.near_duplicates(no_documents).collect() == []


def test_first_of_each_keeps_one_row(odd_documents, no_documents):
    kept = simhash.first_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[6] <= 2 and ids[None] == 0 and ids[1] == 1 and 2 not in ids and 13 not in ids
    assert simhash.first_of_each(no_documents).count() == 0


def test_first_of_each_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(25):
        base = rng.integers(0, 5000, rng.integers(60, 400))
        texts.append(base)
        for share in (0.002, 0.005, 0.01, 0.02, 0.04):
            copy = base.copy()
            copy[rng.random(len(copy)) < share] = 9999
            texts.append(copy)
    rows = [(i, " ".join(f"w{x}" for x in text)) for i, text in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    prints = {r["doc_id"]: r["fingerprint"] % 2**64 for r in simhash.fingerprints(documents).collect()}
    roots = components([prints[i] for i in range(len(texts))], 4)
    kept = {r["doc_id"] for r in simhash.first_of_each(documents).collect()}
    assert kept == {i for i, root in enumerate(roots) if root == i} and 25 <= len(kept) < 120


# Token files


@pytest.fixture(scope="module")
def definition():
    from flockscan.llm.queries import tokenizer_definition

    return tokenizer_definition()


def test_encoder_equals_the_library(definition):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choices(" \n\tab.'s1<é\u00a0\u3000日|", k=rng.randint(0, 30))) for _ in range(800)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", " ", "x" * 5000, "", "don't  I'll"]
    encoder = token_files.Encoder(definition, remembered=50)
    for part in (texts[:300], texts[300:], texts):
        ids, counts = encoder(*token_files.text_buffer(pa.array([*part, None])))
        got = np.split(ids, np.cumsum(counts)[:-1])
        for text, own in zip([*part, ""], got, strict=True):
            assert own.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_where_special_tokens_take_spaces_away(definition):
    changed = json.loads(definition)
    changed["added_tokens"][0] |= {"lstrip": True, "single_word": False}
    changed = json.dumps(changed)
    encoder = token_files.Encoder(changed)
    texts = ["a bc <|endoftext|> d", " <|endoftext|>", "no \nword\n <|endoftext|>x y"]
    ids, counts = encoder(*token_files.text_buffer(pa.array(texts)))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_grammar_round_trip_and_spans():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.tile(rng.integers(0, 50, 40), 30), rng.integers(0, 50, 500), np.zeros(100, int)])
    counts = np.array([1, 700, 999, len(ids) - 1700])
    grammar, symbols, left = token_files.re_pair(ids, counts, 50, least_count=4)
    assert len(symbols) < 0.7 * len(ids) and len(grammar.pairs) > 20
    assert np.array_equal(grammar.decode(symbols), ids)
    ends = np.cumsum(left)
    assert np.array_equal(np.add.reduceat(grammar.sizes(symbols), ends - left), counts)
    for low, high in ((0, 1), (5, 300), (699, 702), (len(ids) - 3, len(ids))):
        assert np.array_equal(grammar.decode_span(symbols, low, high), ids[low:high])
    for k, (pair, size) in enumerate(zip(grammar.pairs, grammar.lengths, strict=True)):
        assert size == grammar.sizes(pair).sum() and (pair < 50 + k).all()


def _most_frequent_pair(symbols, counts):
    """How often the most frequent pair occurs within documents, without overlaps."""
    seen, ends = Counter(), np.cumsum(counts)
    for low, high in zip(ends - counts, ends, strict=True):
        own, taken = symbols[low:high].tolist(), {}
        for i, pair in enumerate(zip(own, own[1:])):
            if pair[0] != pair[1] or taken.get(pair) != i - 1:
                seen[pair] += 1
                taken[pair] = i
    return max(seen.values(), default=0)


def test_grammar_ends_when_no_pair_is_frequent():
    rng = np.random.default_rng(7)
    tiled = np.tile(rng.integers(0, 50_000, 1000), 64)
    grammar, symbols, left = token_files.re_pair(tiled, np.array([len(tiled)]), 50_000)
    assert len(symbols) < 200 and grammar.lengths.max() >= 1000 and np.array_equal(grammar.decode(symbols), tiled)
    runs = np.zeros(5000, np.int64)
    skewed = (rng.random(6000) ** 4 * 40).astype(np.int64)
    for ids, counts in ((runs, [5000]), (runs, [1, 2, 3, 4994]), (skewed, [6000]), (skewed, [1] * 1000 + [5000])):
        for least in (2, 3, 24):
            grammar, symbols, left = token_files.re_pair(ids, np.array(counts), 40, least)
            assert np.array_equal(grammar.decode(symbols), ids) and _most_frequent_pair(symbols, left) < least
            ends = np.cumsum(left)
            assert np.array_equal(np.add.reduceat(grammar.sizes(symbols), ends - left), counts)
    grammar, symbols, left = token_files.re_pair(skewed, np.array([6000]), 40, 7_000)
    assert len(grammar.pairs) == 0 and np.array_equal(symbols, skewed)


def test_token_files_on_odd_rows(spark, odd_documents, no_documents, definition):
    for documents, n in ((odd_documents, 18), (no_documents, 0)):
        path = new_path(spark, "tokens")
        token_files.write_token_files(documents, path, definition)
        rows = sorted(token_files.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
        assert len(rows) == n
        assert [r["doc_id"] or -1 for r in rows] == sorted(r["doc_id"] or -1 for r in rows)
        assert all(r["ids"][-1] == 0 and len(r["ids"]) == r["n_tokens"] for r in rows)
    assert {r["n_tokens"] for r in spark.read.parquet(path).collect()} == set()


# URLs


def test_urls_on_odd_rows(spark):
    rules = spark.createDataFrame(
        [("Org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("org", None, "block"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    cases = [
        ("http://A.org/x1?q", "a.org", "/x1", "a.org/x", "block"),
        ("http://b.a.ORG/y#f", "b.a.org", "/y", "org/", "allow"),
        ("ftp://org", "org", "", "org", "block"),
        ("http://borg/x", "borg", "/x", None, "allow"),
        ("no address", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("x\n://c.org\n/z", "c.org\n", "/z", None, "allow"),
        ("http://" + "a." * 5000 + "org/" + "p" * 50_000, "a." * 5000 + "org", "/" + "p" * 50_000, "org/", "allow"),
    ]
    urls_df = spark.createDataFrame([(i % 3, c[0], "old", 1) for i, c in enumerate(cases)] * 2, "page_id int, url string, host string, _slice int")
    got = Counter(tuple(r) for r in urls.judge_urls(urls_df, rules).select("url", "host", "path", "rule", "verdict").collect())
    assert got == Counter({c: 2 for c in cases})
    none = urls.judge_urls(urls_df, rules.limit(0), default="block").collect()
    assert len(none) == 18 and {r["verdict"] for r in none} == {"block"}
    assert urls.judge_urls(urls_df.limit(0), rules).count() == 0


# Line runs


def test_line_runs_on_odd_rows(odd_documents, no_documents):
    rows = line_runs.remove_repeated_runs(odd_documents).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == 18
    assert tuple(by_id[1])[1:] == (0, 0, None) and tuple(by_id[2])[1:] == (1, 0, "")
    assert by_id[9]["n_removed"] == 0 and by_id[10]["kept"] == "fifth"
    assert (by_id[11]["n_lines"], by_id[11]["n_removed"], by_id[11]["kept"]) == (10, 8, "\n")
    assert line_runs.remove_repeated_runs(no_documents).count() == 0


def test_line_runs_of_a_text_of_many_lines(spark):
    lines = [f"line {i}" for i in range(200_000)]
    texts = [(1, "a\nb\nc"), (2, "\n".join(lines[:100_000] + ["a", "b", "c"] + lines[100_000:]))]
    rows = line_runs.remove_repeated_runs(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    found = {r["doc_id"]: r for r in rows}
    assert found[2]["n_removed"] == 3 and found[2]["kept"] == "\n".join(lines)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5, 6])
def test_line_runs_equal_brute_force(spark, min_lines):
    rng = np.random.default_rng(min_lines)
    texts = ["\n".join(map(str, rng.integers(0, 3, rng.integers(0, 25)))) for _ in range(25)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    seen, expected = set(), {}
    for doc, text in enumerate(texts):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - min_lines + 1):
            run = tuple(lines[i : i + min_lines])
            if run in seen:
                gone |= set(range(i, i + min_lines))
            seen.add(run)
        expected[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    found = line_runs.remove_repeated_runs(rows, min_lines).collect()
    assert {r["doc_id"]: (r["kept"], r["n_removed"]) for r in found} == expected


def test_ranks_are_a_suffix_array(spark):
    lines = [(0, 0, i, x, x) for i, x in enumerate([2, 1, 2, 1, 2, 1, 3])] + [(1, 0, i, x, x) for i, x in enumerate([1, 2, 1])]
    ranked = line_runs.suffix_ranks(spark.createDataFrame(lines, "doc long, key long, pos int, id long, id2 long"), 3)
    rows = sorted(ranked.collect(), key=lambda r: (r["rank"], r["doc"], r["pos"]))
    # Runs of three: 1 2 1 at four places, 2 1 2 at two.
    assert [(r["doc"], r["pos"]) for r in rows] == [(0, 1), (0, 3), (1, 0), (0, 0), (0, 2)]
    assert {tuple(r["first"]) for r in rows} == {(0, 0, 1), (0, 0, 0)}


# WARC


def test_warc_on_odd_rows(spark):
    big = "é" * 70_000
    pages = [
        (1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "big", big),
        (6, "big", big + "x"), (6, "big", big + "x"), (7, "z", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "lonely"), (8, "b2", big),
    ]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id bigint, url string, html string, name string").repartition(2)
    path = new_path(spark, "warc")
    warc.write_archives(df, path, archive_bytes=50_000)
    rows = sorted(warc.read_archives(spark, path).collect(), key=lambda r: (r["page_id"] or 0, r["record_type"]))
    assert len(rows) == len(pages)
    html = {1: "same", 2: "same", 3: "", 4: "", 5: big, 6: big + "x", 7: pages[7][2], None: "lonely", 8: big}
    for r in rows:
        payload = html[r["page_id"]].encode()
        digest = warc.base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), digest)
        assert r["payload"] == (payload if r["record_type"] == "response" else None)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows}
    assert kinds[1] == ("revisit", 2) and kinds[3] == ("revisit", 4) and kinds[5] == ("revisit", 8)
    assert kinds[6] == ("response", None) and [r["page_id"] for r in rows].count(6) == 2
    # Equal id and URL, different pages of several segments.
    path = new_path(spark, "warc")
    alike = spark.createDataFrame([(9, "u", c * 100_000) for c in "ab"], "page_id bigint, url string, html string")
    warc.write_archives(alike, path)
    assert sorted(bytes(r["payload"][:2]) for r in warc.read_archives(spark, path).collect()) == [b"aa", b"bb"]
    path = new_path(spark, "warc")
    warc.write_archives(df, path, least_bytes=5)
    small = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, path, with_payload=False).collect()}
    assert small[1] == small[2] == small[3] == "response" and small[5] == "revisit"
    path = new_path(spark, "warc")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_broken_segments_and_chunks_are_told():
    row = {"html": b"abc" * 100, "name": "<urn:page:1:00>", "url": "u", "refers_to": None}
    parts = [r for record in warc.page_records(row, 100) for r in warc.records(record)]
    pieces = [(int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, b) for f, b in parts]
    assert warc.payload_of(warc.joined_segments(pieces[::-1] + pieces[:1]))[1] == row["html"]
    for bad in (pieces[:-1], pieces[1:], [*pieces[:-1], (pieces[-1][0], 7, pieces[-1][2])], [*pieces, (1, None, b"?")]):
        with pytest.raises(warc.BrokenArchive):
            warc.joined_segments(bad)
    for body in (b"5\r\nabc", b"3\r\nabcd\r\n0\r\n\r\n", b""):
        with pytest.raises(warc.BrokenArchive):
            warc.payload_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + body)
    whole = next(warc.page_records(row))
    for cut in (whole[:-40], b"?" + whole):
        with pytest.raises(warc.BrokenArchive):
            list(warc.records(cut))


# Mixing


def test_weights_meet_limit_and_entropy(spark):
    totals = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 90), ("none", 0)], "source string, n_tokens bigint")
    rows = {r["source"]: r for r in mixing.source_weights(totals, limit=4.0).collect()}
    assert rows["none"]["weight"] == 0 and math.isclose(sum(r["weight"] for r in rows.values()), 1)
    assert rows["a"]["budget"] == 9000 and abs(rows["c"]["budget"] / 90 - 4) < 0.02
    assert {r["exponent"] for r in mixing.source_weights(totals, limit=1e6).collect()} == {0.0}
    rows = mixing.source_weights(totals, limit=None, entropy=0.8).collect()
    assert math.isclose(-sum(r["weight"] * math.log(r["weight"]) for r in rows if r["weight"]), 0.8, abs_tol=1e-9)
    with pytest.raises(ValueError, match="limit"):
        mixing.source_weights(totals, limit=2.0, entropy=1.0)


def test_mixture_meets_its_budgets(spark):
    texts = [(i, "w " * (5 + i % 7), "a" if i % 5 else "b") for i in range(600)]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string, source string")
    plan = mixing.plan_mixture(documents, limit=2.5, block_tokens=100).collect()
    for source in "ab":
        own = [r for r in plan if r["source"] == source]
        used, budget = sum(r["n_tokens"] * r["copies"] for r in own), own[0]["budget"]
        assert budget <= used < budget + 12 and min(r["copies"] for r in own) >= 1
    assert len({r["block"] for r in plan if r["source"] == "a"}) > 20
    mixed = mixing.mixed_documents(documents, limit=2.5, block_tokens=100)
    assert Counter(r["doc_id"] for r in mixed.collect()) == {r["doc_id"]: r["copies"] for r in plan}


def test_mixture_equals_running_sums(spark):
    spread = [(i, "w " * (i % 9), "a" if i % 4 else "b") for i in range(400)]
    crowd = [(None, "v " * (1 + i % 300), "a") for i in range(600)] + [(7, "u u u", "b")] * 200
    documents = spark.createDataFrame(spread + crowd, "doc_id bigint, text string, source string").repartition(7)
    plan = mixing.plan_mixture(documents, limit=1.7, block_tokens=500).collect()
    assert len(plan) == 1200
    # Rows without an id are dealt over the blocks.
    assert len({r["block"] for r in plan if r["doc_id"] is None}) > 100
    for source in "ab":
        own = [r for r in plan if r["source"] == source]
        tokens = sum(r["n_tokens"] for r in own)
        passes, rest = divmod(own[0]["budget"], tokens)
        sizes = Counter()
        for r in own:
            sizes[r["block"]] += r["n_tokens"]

        def drawn(block, source=source):
            return int(hashlib.md5(f"order:{source}:{block}".encode()).hexdigest()[:8], 16), block

        left = rest
        for block in sorted(sizes, key=drawn):
            rows = {(r["doc_id"], r["text_key"]): 0 for r in own if r["block"] == block and r["n_tokens"]}
            for r in own:
                if (r["doc_id"], r["text_key"]) in rows:
                    rows[r["doc_id"], r["text_key"]] += r["n_tokens"]
            named = {k: str(k[1] if k[0] is None else k[0]) for k in rows}
            begun, more = 0, {}
            for key in sorted(rows, key=lambda k: (hashlib.md5(named[k].encode()).hexdigest(), k[1])):
                more[key] = begun < left
                begun += rows[key]
            for r in own:
                if r["block"] == block:
                    wanted = passes + more[r["doc_id"], r["text_key"]] if r["n_tokens"] else 1
                    assert r["copies"] == wanted
            left -= sizes[block]


def test_mixing_on_odd_rows(odd_documents, no_documents):
    plan = mixing.plan_mixture(odd_documents).collect()
    assert len(plan) == 18 and all(r["copies"] >= 1 for r in plan)
    assert {r["source"] for r in plan} == {"", "a", "b", "c", "d"}
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in odd_documents.collect()}
    assert mixing.plan_mixture(no_documents).count() == mixing.mixed_documents(no_documents).count() == 0
    empty = odd_documents.withColumn("text", F.lit(None).cast("string"))
    assert {r["copies"] for r in mixing.plan_mixture(empty).collect()} == {1}


# Perplexity


def _symbols_of(text):
    text = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
    folded = (c.lower() if "A" <= c <= "Z" else "0" if c in "0123456789" else c for c in text)
    return "".join(c if c == " " or c == "0" or "a" <= c <= "z" or ord(c) > 127 else "#" for c in folded)


def _plain_kneser_ney(texts, order):
    """The log probability of each n-gram of the texts of one language."""
    padded = [" " * (order - 1) + _symbols_of(x) for x in texts]
    counts = {order: Counter(x[i : i + order] for x in padded for i in range(len(x) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p = {}
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (sum(n == m for n in counts[k].values()) for m in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else None
        d = [0.5, 0.5, 0.5]
        if y is not None:
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
            d = [min(max(x, 0.05), high) for x, high in zip(d, (0.95, 1.9, 2.9), strict=True)]
        total, left = Counter(), Counter()
        for g, n in counts[k].items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        for g, n in counts[k].items():
            shorter = p[g[1:]] if k > 1 else 1 / (len(counts[1]) + 1)
            p[g] = (n - d[min(n, 3) - 1] + left[g[:-1]] * shorter) / total[g[:-1]]
    return {g: math.log(p[g]) for g in counts[order]}


def _plain_judgement(rows, below, above):
    """``{doc_id: (log perplexity, within the band)}`` of ``(doc_id, text, lang)`` rows."""
    order, result = perplexity.ORDER, {}
    for lang in {r[2] or "" for r in rows}:
        own = [(i, text) for i, text, x in rows if (x or "") == lang]
        model, score = _plain_kneser_ney([text for _, text in own], order), {}
        for i, text in own:
            padded = " " * (order - 1) + _symbols_of(text)
            if len(padded) >= order:
                parts = [model[padded[j : j + order]] for j in range(len(padded) - order + 1)]
                score[i] = -math.fsum(parts) / len(parts)
        steps = np.array([math.floor(x * perplexity.STEPS + 0.5) for x in score.values()])
        middle = np.median(steps) if len(steps) else 0
        away = np.abs(steps - middle)
        spread = (np.median(away) or away.mean()) if len(steps) else 0
        low, high = (middle - below * spread - 0.5) / 1000, (middle + above * spread + 0.5) / 1000
        result |= {i: (score.get(i), i not in score or low <= score[i] <= high) for i, _ in own}
    return result


def test_judgement_equals_plain_kneser_ney(spark):
    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    wide = "".join(map(chr, range(0x3400, 0x6000)))
    rows = [tuple(r) for r in read] + [
        (-1, "Ёжик в тумане 12.5 \U0001f600\U0001f600 " * 9, "ru"), (-2, wide * 2, "zh"), (-3, None, "en"),
        (-4, "", "en"), (-5, "  ", None), (-6, "a", None), (-7, "\n\n x \x00\x7f", None),
    ]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    plain = _plain_judgement(rows, 4.0, 3.0)
    for head in (perplexity.HEAD, 900, 0):
        for r in perplexity.judge_quality(documents, 4.0, 3.0, head).collect():
            score, inside = plain[r["doc_id"]]
            assert (r["perplexity"] is None) == (score is None)
            assert score is None or math.isclose(math.log(r["perplexity"]), score, rel_tol=1e-9, abs_tol=1e-9)
            assert r["kept"] == (inside and not r["base_failed"])
    assert not all(inside for _, inside in plain.values())
    kept = {r["doc_id"] for r in perplexity.judge_quality(documents, 4.0, 3.0).collect() if r["kept"]}
    for sent in (0, 1 << 20):
        good = perplexity.keep_good(documents, 4.0, 3.0, sent)
        assert {r["doc_id"] for r in good.collect()} == kept and good.columns == documents.columns


def test_counts_added_up_in_parts_are_the_same(spark, monkeypatch):
    texts = ["abc def ghi" * 20, "Été à la plage " * 30, "x", None]
    batch = pa.record_batch([pa.array(["en", "fr", "en", "fr"]), pa.array(texts)], ["lang", "text"])

    def counted():
        seen = Counter()
        for part in perplexity._counts(iter([batch] * 5)):
            for lang, gram, n in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                seen[lang, gram] += n
        return seen

    whole = counted()
    monkeypatch.setattr(perplexity, "PENDING", 4)
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 64)
    assert counted() == whole and sum(whole.values()) == 5 * sum(len(_symbols_of(x)) for x in texts)


def test_bands_reject_gibberish(spark):
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    vocabulary = ["".join(rng.choice(letters[[0, 4, 8, 14, 18, 19, 13, 17]], rng.integers(2, 7))) for _ in range(300)]
    clean = [(i, " ".join(rng.choice(vocabulary, 150)), "en") for i in range(120)]
    noise = [(999, " ".join("".join(rng.choice(letters, 6)) for _ in range(6000)), "en")]
    documents = spark.createDataFrame(clean + noise, "doc_id bigint, text string, lang string")
    judged = {r["doc_id"]: r for r in perplexity.judge_quality(documents).collect()}
    assert not judged[999]["base_failed"] and not judged[999]["kept"]
    assert all(r["kept"] or r["base_failed"] for i, r in judged.items() if i != 999)


def test_bands_of_equal_scores_keep_them(spark):
    text = " ".join(f"w{i} of many" for i in range(60))
    same = [(i, text, "en") for i in range(9)] + [(9, text + " and one more", "en")]
    judged = perplexity.judge_quality(spark.createDataFrame(same, "doc_id bigint, text string, lang string"))
    assert all(r["kept"] for r in judged.collect() if not r["base_failed"] and r["doc_id"] < 9)


def test_quality_on_odd_rows(odd_documents, no_documents):
    rows = perplexity.judge_quality(odd_documents, head=0).collect()
    assert len(rows) == 18 and {r["lang"] for r in rows} == {"", "de", "en", "fr"}
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["base_failed"] and by_id[1]["perplexity"] is None and by_id[4]["n_words"] == 60_000
    # Sums of parts added in another order differ in their last digits.
    plain = lambda rows: sorted(str((*r[:-2], r["perplexity"] and round(r["perplexity"], 9), r["kept"])) for r in rows)
    assert rows[0].__fields__[-2:] == ["perplexity", "kept"]
    assert plain(perplexity.judge_quality(odd_documents).collect()) == plain(rows)
    kept = perplexity.keep_good(odd_documents)
    assert kept.columns == odd_documents.columns and {r["doc_id"] for r in kept.collect()} == {4, 7, 8}
    assert perplexity.judge_quality(no_documents).count() == perplexity.keep_good(no_documents).count() == 0


# Decontamination


@pytest.mark.parametrize("window", [3, 5, 6, 10])
def test_contamination_equals_brute_force(spark, window):
    rng = np.random.default_rng(window)
    texts = [" ".join("abc"[i] for i in rng.integers(0, 3, rng.integers(0, 60))) for _ in range(40)]
    items = [" ".join("ABC"[i] for i in rng.integers(0, 3, rng.integers(0, 14))) for _ in range(12)]
    items += [items[3], None, "unseen words"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(i % 13, t) for i, t in enumerate(items)], "item_id bigint, text string")
    windows = set()
    for i, item in enumerate(items):
        words = (item or "").lower().split()
        size = min(len(words), window)
        windows |= {(tuple(words[j : j + size]), i % 13) for j in range(len(words) - size + 1) if size}
    for r in decontaminate.find_contamination(documents, benchmark, window).collect():
        words, hit, ids = texts[r["doc_id"]].split(), set(), set()
        for run, item in windows:
            for j in range(len(words) - len(run) + 1):
                if tuple(words[j : j + len(run)]) == run:
                    hit |= set(range(j, j + len(run)))
                    ids.add(str(item))
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(words), len(hit), sorted(ids))


def test_contamination_on_odd_rows(spark, odd_documents, no_documents):
    benchmark = spark.createDataFrame([(1, "it is that a clean SENTENCE", "x"), (2, "one  two", "x"), (3, None, "x"), (None, "third line fourth", "x")], "item_id bigint, text string, row string")
    rows = decontaminate.find_contamination(odd_documents, benchmark).collect()
    assert len(rows) == 18 and {r["doc_id"] for r in rows if r["n_hit"]} == {12, 13, 9, 10, 11}
    assert {tuple(r["items"]) for r in rows if r["doc_id"] == 12} == {("2",)}
    kept = decontaminate.drop_contaminated(odd_documents, benchmark)
    assert kept.columns == odd_documents.columns and kept.count() == 13
    assert decontaminate.find_contamination(no_documents, benchmark).count() == 0
    assert {r["n_hit"] for r in decontaminate.find_contamination(odd_documents, benchmark.limit(0)).collect()} == {0}


# Substrings


@pytest.mark.parametrize(("window", "remembered"), [(6, 1 << 20), (8, 1 << 20), (20, 1 << 20), (8, 3)])
def test_substrings_equal_brute_force(spark, window, remembered):
    rng = np.random.default_rng(window)
    shared = [" ".join(map(str, rng.integers(0, 4, 30))) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [" ".join(map(str, rng.integers(0, 3, rng.integers(0, 30)))), shared[rng.integers(0, 4)]]
        texts.append("\n".join(parts[: rng.integers(0, 3)]))
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    seen, expected = set(), {}
    for doc, text in enumerate(texts):
        words, gone = text.split(), set()
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            gone |= set(range(i, i + window)) if run in seen else set()
            seen.add(run)
        expected[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    found = substrings.remove_repeats(documents, window, remembered).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == expected


def test_substrings_on_odd_rows(odd_documents, no_documents):
    rows = substrings.remove_repeats(odd_documents).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 18 and by_id[1]["kept"] == "" and by_id[5]["n_words"] == 1
    assert by_id[8]["kept"] == "before after" and by_id[4]["n_removed"] == 0
    assert substrings.remove_repeats(no_documents).count() == 0


# Classifier


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.9, 0.6])
    right = rng.random((len(truth), 7)) < accuracy
    votes = np.where(right == truth[:, None], 2, 0)
    votes[rng.random(votes.shape) < 0.3] = 1
    patterns, counts = np.unique(votes @ 3 ** np.arange(7), return_counts=True)
    model = quality.label_model(patterns, counts)
    assert abs(model["prior"] - 0.8) < 0.03 and np.abs(model["accuracy"] - accuracy).max() < 0.05


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    texts = [(None, f"{'The' if i % 3 else '### $$$'} text {i} of the day. " * (1 + i % 9), i) for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string, n int")
    found = []
    for order in (frame.repartition(5), frame.orderBy(F.desc("n")).coalesce(2)):
        rows = quality.classify_quality(order, train_rows=20).collect()
        found.append({r["text_key"]: r["score"] for r in rows})
    # Up to the rounding of sums, which run over blocks of texts.
    assert found[0] == pytest.approx(found[1], abs=1e-9)


def test_classifier_on_odd_rows(odd_documents, no_documents):
    rows = quality.classify_quality(odd_documents).collect()
    assert len(rows) == 18 and all(0 <= r["score"] <= 1 and r["posterior"] is not None for r in rows)
    assert quality.classify_quality(no_documents).count() == 0
