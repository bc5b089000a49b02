"""Whitening, Merkle manifest and token counts: brute force, odd rows and empty tables."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockscan.llm import manifest, queries, token_counts, whitening

ODD_TEXTS = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \n\t ", "", "a"),
    (4, "word " * 60_000, "en", "b"),
    (5, "z" * 200_000, "é", None),
    (6, "tie", "en", "b"),
    (6, "tie", "en", "b"),
    (6, "tied", "en", "b"),
    (None, "tie", "en", "b"),
    (None, None, None, None),
    (7, "été <|endoftext|> a  b c<|endoftext|>", "fr", "d"),
]


@pytest.fixture(scope="module")
def odd_documents(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "k", 7, 0, 1) for i, t, lang, s in ODD_TEXTS]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, place int, n int, tie int"
    return spark.createDataFrame(rows, schema).repartition(3)


# Whitening


def integers(vectors):
    return np.floor(256 * np.asarray(vectors, np.float64)).astype(np.int64)


def check_whitening(rows, vectors):
    """Rows by id and component against a plain computation; ``vectors`` by id."""
    x = {i: integers(v) for i, v in vectors.items()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(4, len(values))
    assert sorted({(r["vec_id"], r["component"]) for r in rows}) == sorted((i, c + 1) for i in x for c in range(k))
    whitened = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    for r in rows:
        own = x[r["vec_id"]]
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, sums, strict=True))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    for c in range(k):
        plain = {i: (v - sums / n) @ basis[:, c] / np.sqrt(values[c]) for i, v in x.items()}
        sign = np.sign(sum(plain[i] * whitened[i, c + 1] for i in x))
        assert all(sign * plain[i] == pytest.approx(whitened[i, c + 1], abs=1e-7) for i in x)


def test_whitening_equals_brute_force(spark, sf_dir):
    rows = queries.op11_whitening(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(rows, {r[0]: r[1] for r in table})


def test_whitening_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = {i: [float(v) for v in rng.normal(size=3)] for i in range(20)}
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0, None, 2.0], [nan, 0.0, 0.0], [0.0, -inf, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows = [(i, v, 0, 0) for i, v in good.items()] + [(100 + i, v, 0, 0) for i, v in enumerate(bad)]
    rows += [(20, good[3], 1, 1)]
    schema = "vec_id bigint, embedding array<double>, x int, n int"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    check_whitening(whitening.whiten(frame).collect(), {**good, 20: good[3]})
    again = whitening.whiten(spark.createDataFrame([(None, good[0]), (1, good[1]), (1, good[1])], "vec_id bigint, embedding array<double>"))
    # Two distinct vectors vary along one line.
    found = [(r["vec_id"], r["component"]) for r in again.collect()]
    assert sorted(found, key=str) == [(1, 1), (1, 1), (None, 1)]
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.filter("vec_id = 100")).count() == 0
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(alike).count() == 0


def test_sums_are_exact_for_large_entries(spark):
    rng = np.random.default_rng(6)
    values = {i: [float(v) for v in rng.integers(-(2**44), 2**44, 5)] for i in range(200)}
    frame = spark.createDataFrame(list(values.items()), "vec_id bigint, embedding array<double>").repartition(7)
    x = integers(list(values.values()))
    usable, column = whitening.whole_vectors(frame, "embedding")
    fit = usable.select(column.alias("x"))
    model = whitening.fit_whitening(fit, 5, int(np.abs(x).max()))
    assert model.sums == [sum(map(int, c)) for c in x.T] and model.n == 200
    trace = sum(Fraction(sum((200 * int(v) - s) ** 2 for v in c)) for c, s in zip(x.T, model.sums, strict=True)) / 200**3
    assert model.trace == pytest.approx(float(trace), rel=1e-15)
    assert {r["deviation"] for r in whitening.whiten(frame).collect()} == {None}


@pytest.mark.parametrize("gap", [0.0, 1e-14, 1e-9, 1e-5])
def test_eigenvectors_of_clusters(gap):
    rng = np.random.default_rng(5)
    values = np.array([5.0, 5.0 + 5 * gap, 3.0, 3.0 * (1 + gap), 3.0 * (1 - gap), 1.0, 1e-3, 0.0], whitening.High)
    basis, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    basis = basis.astype(whitening.High)
    for _ in range(3):
        basis = basis @ (3 * np.eye(8, dtype=whitening.High) - basis.T @ basis) / 2
    matrix = basis * values @ basis.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.eigen(matrix)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-17
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-17
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-17
    if gap >= 1e-9:
        own = np.abs(vectors.T @ basis[:, np.argsort(-values)])
        assert np.abs(own - np.eye(8)).max() < 1e-8


# Manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0) -> str:
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"] if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests: list[str], arity: int):
    """``(root, proofs)``: for each leaf the siblings left and right of each level."""
    proofs = [[] for _ in digests]
    own, row = list(range(len(digests))), digests
    while len(row) > 1:
        runs = [row[i : i + arity] for i in range(0, len(row), arity)]
        for i, place in enumerate(own):
            run, slot = runs[place // arity], place % arity
            proofs[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        own = [place // arity for place in own]
        row = [digest(*run) for run in runs]
    return row[0], proofs


def plain_manifest(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, bytes.fromhex(leaf(r))))
        trees[name] = tree([leaf(r) for r in groups[name]], arity)
    root, above = tree([trees[name][0] for name in names], arity)
    out = []
    for name, upper in zip(names, above, strict=True):
        for row, proof in zip(groups[name], trees[name][1], strict=True):
            changed = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            folded = manifest.root_of(leaf(row, changed), proof + upper)
            out.append((row["doc_id"], leaf(row), trees[name][0], root, proof + upper, folded))
    return sorted(out, key=str)


@pytest.mark.parametrize(("arity", "block"), [(2, 4), (2, 4096), (3, 3), (5, 30)])
def test_manifest_equals_brute_force(spark, odd_documents, arity, block):
    made = [(i, f"text {i}", f"l{i % 3}" if i % 5 else "l0", "s", i) for i in range(11, 150)]
    frame = odd_documents.select("doc_id", "text", "lang", "source", "n_chars", "tree", "place", "n", "tie")
    more = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame = frame.unionByName(more, allowMissingColumns=True)
    found = manifest.merkle_manifest(
        frame,
        FIELDS,
        altered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
        changed={"n_chars": F.col("n_chars") + 1},
        arity=arity,
        block=block,
    )
    rows = [(r[0], r[1], r[2], r[3], [tuple(s) for s in r[4]], r[5]) for r in found.collect()]
    assert sorted(rows, key=str) == plain_manifest(frame.collect(), arity)
    assert all(manifest.root_of(r[1], r[4]) == r[3] for r in rows)


def test_manifest_of_little(spark, odd_documents):
    assert manifest.merkle_manifest(odd_documents.limit(0), FIELDS).count() == 0
    (one,) = manifest.merkle_manifest(odd_documents.filter("doc_id = 2"), FIELDS).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == []


def test_manifest_query_on_odd_rows(spark, odd_documents, tmp_path):
    odd_documents.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    expected = [
        (i, digest_, subroot, root, digest(*(x for step in proof for x in step)), folded, folded == root)
        for i, digest_, subroot, root, proof, folded in plain_manifest(odd_documents.collect(), 2)
    ]
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)


# Token counts


@pytest.fixture(scope="module")
def definition():
    return queries.tokenizer_definition()


@pytest.fixture(scope="module")
def library(definition):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_equal_the_library(spark, sf_dir, library):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_token_counts(spark, sf_dir).collect()}
    for doc, text in texts:
        n = library(text)
        assert rows[doc] == (len((text or "").encode()), n, n > 1024)
    assert len(rows) == len(texts)


def test_token_counts_on_odd_rows(spark, odd_documents, definition, library):
    rows = token_counts.count_tokens(odd_documents, definition, 3).collect()
    expected = [(i, len((t or "").encode()), library(t), library(t) > 3) for i, t, *_ in ODD_TEXTS]
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert token_counts.count_tokens(odd_documents.limit(0), definition).count() == 0


def test_counter_on_odd_characters(definition, library):
    import pyarrow as pa

    from flockscan.llm.words import text_buffer

    rng = np.random.default_rng(3)
    letters = [*"ab \n\t 　é漢🎉'sdt19.,!\x00\x1c\u0085 ", "<|endoftext|>", "<|end", "  "]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(1500)]
    texts += ["<|endoftext|>" * 3, " <|endoftext|> ", "it's I'll 'tis", "a   ", None, ""]
    counter = token_counts.Counter(definition, remembered=50)
    for _ in range(2):
        assert counter(*text_buffer(pa.array(texts))).tolist() == [library(t) for t in texts]


def test_both_ways_of_merging_agree(definition, library):
    merges = token_counts.Merges(definition)
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice([*"etaoinshr"], n)) for n in rng.integers(1, 3000, 60)] + ["a" * 999, "ab" * 700]
    symbols = merges.letters[np.frombuffer("".join(words).encode("utf-16-le"), "<u2")]
    counts = np.array([len(w) for w in words])
    expected = [library(w) for w in words]
    assert token_counts.surviving(symbols, counts, merges, long=10**6).tolist() == expected
    assert token_counts.surviving(symbols, counts, merges, long=0).tolist() == expected


def test_other_kinds_of_tokenizers_are_refused(definition):
    import json

    spec = json.loads(definition)
    spec["normalizer"] = {"type": "NFC"}
    with pytest.raises(ValueError):
        token_counts.Merges(json.dumps(spec))
    spec = json.loads(definition)
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        token_counts.Merges(json.dumps(spec))
