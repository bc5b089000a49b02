"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. How often each pattern of
votes occurs is all that expectation maximisation needs to estimate the labellers'
accuracies, without any given label. The posterior of a document's pattern is its label;
on these a linear scorer over hashed features is trained, which then judges all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockscan.llm.mixing import draw
from flockscan.llm.words import (
    BLANK_PARTED,
    LOWER,
    Words,
    blocks,
    mixed,
    run_hashes,
    split_words,
    text_buffer,
    word_hashes,
)
from flockscan.storage import save

# Documents the scorer is trained on, at most; those of least random draw.
TRAIN_ROWS = 10_000
FEATURE_BITS = 12
FEATURES = 1 << FEATURE_BITS
EPOCHS, STEP, BATCH = 30, 0.5, 64
THRESHOLD = 0.5

# Frequent words of the languages at hand.
STOP_WORDS = (
    "the of and to in is that it for on with as was at by this be are or an a he "
    "de la le et les des en un une du que est pour dans sur au par avec "
    "el los las y una con por se del para su al es no "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch"
).split()
# Marks that end a sentence, and characters counted as symbols.
SENTENCE_ENDS = b".!?"
SYMBOLS = b"#*$%&|<>{}[]\\^~=_@+"

# Statistics of a text, each with the values up to which, and from which on, its labeller
# votes; between them it has no vote. The first is a vote for bad if ``low_is_bad``.
LABELLERS = (
    ("words", 20.0, 60.0, True),
    ("symbols_per_word", 0.05, 0.25, False),
    ("upper_share", 0.3, 0.6, False),
    ("repeat_share", 0.15, 0.5, False),
    ("stop_share", 0.02, 0.1, True),
    ("sentence_share", 0.005, 0.02, True),
    ("distinct_share", 0.2, 0.4, True),
)
NAMES = tuple(name for name, *_ in LABELLERS)
# Edges of the steps in which a statistic becomes a feature.
STEPS = (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 2.0, 20.0, 60.0)

_END, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_END[list(SENTENCE_ENDS)] = True
_SYMBOL[list(SYMBOLS)] = True


def _listed(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(word_hashes(Words(data, np.r_[0, ends[:-1]], ends, np.array([0, len(raw)]))))


def _within(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), at))


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of the labellers' statistics for each text."""
    n_texts = len(at) - 1
    words = split_words(LOWER[data], at, BLANK_PARTED)
    hashes, text, n = word_hashes(words), words.text_of(), words.counts
    runs = run_hashes(hashes, 3)
    place = np.flatnonzero(words.left()[: len(runs)] >= 3)
    key = mixed(runs[place] ^ mixed(text[place].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    repeats = np.bincount(text[place[order[1:][same]]], minlength=n_texts)
    distinct = np.bincount(
        text[np.unique(mixed(hashes ^ mixed(text.astype(np.uint64))), return_index=True)[1]], minlength=n_texts
    )
    # What marks follow or enclose a word is no part of it here.
    last = words.data[words.ends - 1]
    stops = np.bincount(text[np.isin(hashes, _listed(STOP_WORDS))], minlength=n_texts)
    ends = np.bincount(text[_END[last]], minlength=n_texts)
    upper = _within((data >= 0x41) & (data <= 0x5A), at)
    letters = upper + _within((data >= 0x61) & (data <= 0x7A), at)
    some = np.maximum(n, 1)
    return np.column_stack(
        [
            n,
            _within(_SYMBOL[data], at) / some,
            upper / np.maximum(letters, 1),
            repeats / some,
            stops / some,
            ends / some,
            # Long texts repeat words anyway.
            distinct / np.maximum(np.minimum(n, 200), 1),
        ]
    ).astype(np.float64)


def votes_of(stats: np.ndarray) -> np.ndarray:
    """1 for good, -1 for bad, 0 for no vote; a column per labeller."""
    out = np.zeros(stats.shape, np.int8)
    for i, (_, low, high, low_is_bad) in enumerate(LABELLERS):
        sign = -1 if low_is_bad else 1
        out[:, i] = np.where(stats[:, i] <= low, sign, np.where(stats[:, i] >= high, -sign, 0))
    return out


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes as one number in base 3."""
    base = 3 ** np.arange(len(LABELLERS))
    for batch in blocks(batches):
        votes = votes_of(statistics(*text_buffer(batch.column("text"))))
        code = (votes.astype(np.int64) + 1) @ base
        yield pa.record_batch(
            [batch.column("draw"), batch.column("text_key"), pa.array(code, pa.int32())], ["draw", "text_key", "pattern"]
        )


# The label model


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> dict:
    """Accuracies and class balance from how often each pattern of votes occurs.

    Labellers are taken as independent given the class. Returns ``prior`` of good, ``good``
    and ``bad`` (for each labeller the chance of votes -1, 0, 1 in that class),
    ``accuracy`` of the votes given, and ``posterior`` of good for each pattern.
    """
    votes = (patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3).astype(int)
    balance = (votes == 2).sum(1) - 2 * (votes == 0).sum(1)
    posterior = np.where(balance > 0, 0.9, 0.1)
    each = np.arange(len(LABELLERS))
    for _ in range(rounds):
        tables = []
        for weight in (counts * posterior, counts * (1 - posterior)):
            n = np.stack([np.bincount(votes[:, i], weight, 3) for i in each]) + 1.0
            tables.append(n / n.sum(1, keepdims=True))
        good, bad = tables
        prior = (counts @ posterior + 1) / (counts.sum() + 2)
        odds = np.log(prior / (1 - prior)) + (np.log(good[each, votes]) - np.log(bad[each, votes])).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - posterior).max(initial=0) < 1e-6
        posterior = new
        if done:
            break
    right = prior * good[:, 2] + (1 - prior) * bad[:, 0]
    given = right + prior * good[:, 0] + (1 - prior) * bad[:, 2]
    return {"prior": prior, "good": good, "bad": bad, "accuracy": right / given, "posterior": posterior}


# The scorer


def _hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, first)``: the bucket of each byte trigram, text by text."""
    n = len(data)
    if n < 3:
        return np.empty(0, np.int64), np.zeros(len(at), np.int64)
    code = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << 8 | data[2:].astype(np.uint32) << 16
    bucket = ((code * np.uint32(2_654_435_761)) >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)
    whole = np.ones(n - 2, bool)
    for end in at[1:]:
        whole[max(end - 2, 0) : end] = False
    place = np.flatnonzero(whole)
    return bucket[place], np.searchsorted(place, at)


def _steps(stats: np.ndarray) -> np.ndarray:
    """The numbers of the features that the statistics switch on, behind the hashed ones."""
    step = np.searchsorted(STEPS, stats, "right")
    return FEATURES + np.arange(stats.shape[1]) * (len(STEPS) + 1) + step


WEIGHTS = FEATURES + len(LABELLERS) * (len(STEPS) + 1) + 1


def _scores(data: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bucket, first = _hashed(data, at)
    total = np.concatenate([[0.0], np.cumsum(weights[bucket])])[first]
    mean = np.diff(total) / np.maximum(np.diff(first), 1)
    z = mean * np.sqrt(FEATURES) + weights[_steps(statistics(data, at))].sum(1) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature numbers and values of each text, at most ``WEIGHTS`` of them."""
    for batch in blocks(batches):
        data, at = text_buffer(batch.column("text"))
        bucket, first = _hashed(data, at)
        steps = _steps(statistics(data, at))
        index, value = [], []
        for i in range(batch.num_rows):
            own, n = np.unique(bucket[first[i] : first[i + 1]], return_counts=True)
            index.append(np.concatenate([own, steps[i], [WEIGHTS - 1]]).astype("<i4").tobytes())
            shares = n / max(n.sum(), 1) * np.sqrt(FEATURES)
            value.append(np.concatenate([shares, np.ones(len(steps[i]) + 1)]).astype("<f4").tobytes())
        yield pa.record_batch(
            [
                *(batch.column(c) for c in ("draw", "text_key", "posterior")),
                pa.array(index, pa.binary()),
                pa.array(value, pa.binary()),
            ],
            ["draw", "text_key", "posterior", "index", "value"],
        )


def fit_scorer(index: list[np.ndarray], value: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on soft targets, by adaptive gradient steps."""
    weights, squares = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        turn = order.permutation(len(target))
        for low in range(0, len(turn), BATCH):
            some = turn[low : low + BATCH]
            at = np.concatenate([index[i] for i in some])
            x = np.concatenate([value[i] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(index[i]) for i in some])
            z = np.bincount(owner, weights[at] * x, len(some))
            error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target[some]
            gradient = np.bincount(at, error[owner] * x, WEIGHTS) / len(some) + 1e-5 * weights
            squares += gradient**2
            weights -= STEP * gradient / np.sqrt(squares)
    return weights


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the weights, from at most ``TRAIN_ROWS`` rows in a fixed order."""
    batches = list(batches)
    if not batches:
        return
    rows = pa.Table.from_batches(batches).sort_by([("draw", "ascending"), ("text_key", "ascending")])
    index = [np.frombuffer(x.as_py(), "<i4") for x in rows["index"]]
    value = [np.frombuffer(x.as_py(), "<f4") for x in rows["value"]]
    weights = fit_scorer(index, value, np.asarray(rows["posterior"], np.float64))
    yield pa.record_batch([pa.array([weights.astype("<f8").tobytes()], pa.binary())], ["weights"])


def _judge(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(len(LABELLERS))
    for batch in blocks(batches):
        data, at = text_buffer(batch.column("text"))
        score = _scores(data, at, weights)
        code = (votes_of(statistics(data, at)).astype(np.int64) + 1) @ base
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(code, pa.int32()), pa.array(score)],
            ["doc_id", "text_key", "pattern", "score"],
        )


def classify_quality(
    documents: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document row: ``doc_id``, ``text_key``, ``pattern``, ``posterior``, ``score``, ``kept``.

    ``pattern`` has the labellers' votes as digits to base 3, ``posterior`` is the label
    model's chance that the document is good, ``score`` the scorer's; it is kept from
    ``threshold`` on. Votes are counted and documents scored over the whole table; the
    scorer is trained on at most ``train_rows`` of them, those of least random draw, of equal
    draws those of least hash of their text, so that scores don't depend on the rows' order.

    A null text is one without words. Repeated rows each count and are scored alike. A null
    ``doc_id`` is an id like any other. Other columns are ignored; an empty table gives an
    empty one.
    """
    spark = documents.sparkSession
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = documents.select(
        "doc_id", F.xxhash64("text").alias("text_key"), draw(F.lit("train"), doc).alias("draw"), "text"
    )
    votes = drawn.select("draw", "text_key", "text").mapInArrow(_patterns, "draw long, text_key long, pattern int")
    voted = save(votes, "votes").frame
    # At most 3 to the power of the number of labellers.
    counted = sorted(map(tuple, voted.groupBy("pattern").count().collect()))
    patterns, counts = np.array(counted, np.int64).reshape(-1, 2).T
    model = label_model(patterns, counts)
    known = spark.createDataFrame(
        [(int(p), float(q)) for p, q in zip(patterns, model["posterior"], strict=True)], "pattern int, posterior double"
    )
    order = F.struct("draw", "text_key")
    least = voted.select(order.alias("place")).orderBy("place").limit(train_rows)
    bound = least.agg(F.max("place")).first()[0] or (None, None)
    # More rows than that only if rows are equal in id and text; any of these will do.
    sample = drawn.filter(order <= F.struct(*(F.lit(x).cast("long") for x in bound))).select("draw", "text_key", "text")
    base = sample.mapInArrow(_sample_patterns, "draw long, text_key long, text string, pattern int")
    features = base.join(known, "pattern").select("draw", "text_key", "posterior", "text").mapInArrow(
        _features, "draw long, text_key long, posterior double, index binary, value binary"
    )
    trained = features.orderBy("draw", "text_key").limit(train_rows)
    fitted = trained.coalesce(1).mapInArrow(_fit, "weights binary").first()
    weights = spark.sparkContext.broadcast(np.frombuffer(fitted[0], "<f8") if fitted else np.zeros(WEIGHTS))
    kind = documents.schema["doc_id"].dataType.simpleString()
    judged = drawn.select("doc_id", "text_key", "text").mapInArrow(
        lambda batches: _judge(batches, weights.value), f"doc_id {kind}, text_key long, pattern int, score double"
    )
    return judged.join(known, "pattern", "left").select(
        "doc_id", "text_key", "pattern", "posterior", "score", (F.col("score") >= threshold).alias("kept")
    )


def _sample_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        (codes,) = _patterns([batch])
        yield pa.record_batch([*batch.columns, codes.column("pattern")], ["draw", "text_key", "text", "pattern"])
