"""Queries against their SQL, and against brute force where SQL can't express them."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pytest
import xxhash
from oracle import compare, connect

import __spark_entry__ as registered
import corpus_pipeline
from helpers import components
from flockscan.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    rows, problem = compare(spark, con, name, sf_dir)
    assert rows and not problem


def test_every_operator_is_registered():
    names = registered.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run


def simhash(text: str | None, size: int = 4) -> int:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in queries.op1_simhash(spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = [simhash(texts[i]) for i in ids]
    assert [int(rows[i]["fingerprint"], 16) for i in ids] == prints
    assert all(len(rows[i]["fingerprint"]) == 16 for i in ids)
    assert [rows[i]["component_id"] for i in ids] == [ids[i] for i in components(prints, 4)]


def test_token_files_equal_the_tokenizer(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(queries.tokenizer_definition())
    start, expected = 0, []
    for doc in sorted(texts):
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op2_token_files(spark, sf_dir).collect())) == expected


def test_quality_counts_equal_brute_force(spark, sf_dir, texts):
    for row in queries.op7_quality_rules(spark, sf_dir).collect():
        text = texts[row["doc_id"]] or ""
        words = WORD.findall(text)
        runs = list(zip(words, words[1:], words[2:], strict=False))
        often = collections.Counter(runs)
        covered = {i + j for i, run in enumerate(runs) if often[run] > 1 for j in range(3)}
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                repeated += line in seen
                seen.add(line)
        marks = len(re.findall(r"[#*$%&|<>]", text))
        assert tuple(row)[1:6] == (len(words), sum(map(len, words)), marks, repeated, len(covered))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert row["base_failed"] == failed and not (failed and row["kept"])


def test_quality_keeps_good_documents(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op7_quality_rules(spark, sf_dir).collect()
    assert all(r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"])


def test_bands_reject_junk_that_passes_the_base_rules(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op7_quality_rules(spark, sf_dir).collect() if not r["base_failed"]]
    junk, clean = ([r["kept"] for r in rows if labels.get(r["doc_id"]) == label] for label in (0, 1))
    assert np.mean(junk) < 0.3 and np.mean(clean) > 0.98


def test_weak_labels_meet_the_given_ones(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op10_quality_classifier(spark, sf_dir).collect()
    right = [r["kept"] == bool(labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    assert len(rows) == 1000 and np.mean(right) > 0.97
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]
    assert np.mean(good) > 0.98


def test_pipeline_equals_brute_force(spark, sf_dir, texts):
    kept = {r["doc_id"] for r in queries.op7_quality_rules(spark, sf_dir).collect() if r["kept"]}
    ids = sorted(kept)
    roots = components([simhash(texts[i]) for i in ids], 4)
    ids = [doc for i, doc in enumerate(ids) if roots[i] == i]
    hit = {r["doc_id"] for r in queries.op8_decontamination(spark, sf_dir).collect() if r["contaminated"]}
    ids = [i for i in ids if i not in hit]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    uses = collections.Counter(r["doc_id"] for r in rows)
    assert set(uses) == set(ids) and set(uses.values()) <= {1, 2, 3}
    whole = {r["doc_id"]: r["ids_crc32"] for r in queries.op2_token_files(spark, sf_dir).collect()}
    assert all(r["ids_crc32"] == whole[r["doc_id"]] for r in rows)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted(r["doc_id"] for r in rows)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(ordered, ordered[1:], strict=False))
