"""Quality rules with an n-gram language model per language.

The model is an interpolated modified Kneser-Ney model over n-grams of characters. Letters
are themselves, A-Z as a-z; a digit, a mark and a run of blanks are one symbol each. Spark
counts the n-grams of all documents, so the model has as many rows as the corpus has
different n-grams and grows with it; it is stored as hashes with log probabilities, sorted
and in ranges. The most frequent n-grams, at most HEAD of them, are sent to the tasks and
scored there, others are joined with the model by hash. As documents are scored by the model
of the same documents, every n-gram is found. A document is rejected if its perplexity lies
outside its language's band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockscan.llm.words import (
    BLANK_PARTED,
    ODD,
    blocks,
    mixed,
    run_hashes,
    split_words,
    text_buffer,
    word_hashes,
)
from flockscan.storage import Saved, save

ORDER = 4
# N-grams of all languages that are sent to the tasks, of 16 bytes each.
HEAD = 1 << 20
# Text bytes handled at once; a character takes some hundred bytes of work space.
BLOCK_BYTES = 1 << 20
# Different n-grams of some forty bytes that a task adds up before it hands them on.
PENDING = 1 << 20
# Rejected texts that are sent to the tasks, of some thirty bytes each; more are joined.
SENT_TEXTS = 1 << 20
# The characters counted as symbols of markup.
MARKS = b"#*$%&|<>"
# Bands reach so many times the median deviation below and above a language's median of
# the log perplexity.
BELOW, ABOVE = 8.0, 8.0
# Log perplexities are compared in steps of 1 / STEPS.
STEPS = 1_000

BLANK, MARK, DIGIT = ord(" "), ord("#"), ord("0")
# Symbols of the ASCII characters.
_SYMBOL = np.full(128, MARK, np.uint32)
_SYMBOL[0x41:0x5B] = np.arange(0x61, 0x7B)
_SYMBOL[0x61:0x7B] = np.arange(0x61, 0x7B)
_SYMBOL[0x30:0x3A] = DIGIT
_SYMBOL[[0x20, *range(0x09, 0x0E)]] = BLANK


def _symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(symbols, first)`` of texts; text i owns symbols first[i]:first[i + 1]."""
    place = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[place]
    symbol = _SYMBOL[lead & 0x7F]
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        head, begin = lead[wide].astype(np.uint32), place[wide]
        after = [padded[begin + i].astype(np.uint32) & 0x3F for i in (1, 2, 3)]
        point = np.select(
            [head < 0xE0, head < 0xF0],
            [(head & 0x1F) << 6 | after[0], (head & 0x0F) << 12 | after[0] << 6 | after[1]],
            (head & 0x07) << 18 | after[0] << 12 | after[1] << 6 | after[2],
        )
        point[(point > 0x10FFFF) | ((point >= 0xD800) & (point < 0xE000)) | (point == 0)] = 0xFFFD
        symbol[wide] = point
    blank = symbol == BLANK
    keep = np.ones(len(symbol), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    # The first character of a text stays.
    keep[np.searchsorted(place, at[:-1][at[:-1] < at[1:]])] = True
    return symbol[keep], np.searchsorted(place[keep], at)


def _packed(symbols: np.ndarray, since: np.ndarray, low: int, high: int) -> Iterator[tuple]:
    """``(low, high, codes, alphabet, bits)``: the n-grams that end at places low to high.

    A code holds an n-gram's symbols as places in the alphabet, the last in the lowest bits.
    Places of too many different symbols for 64 bits are halved. A text begins after blanks.
    """
    start = max(0, low - ORDER + 1)
    seen = np.zeros(0x110000, bool)
    seen[symbols[start:high]] = True
    seen[BLANK] = True
    alphabet = np.flatnonzero(seen)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    if bits * ORDER > 64:
        middle = (low + high) // 2
        yield from _packed(symbols, since, low, middle)
        yield from _packed(symbols, since, middle, high)
        return
    kind = np.uint32 if bits * ORDER <= 32 else np.uint64
    number = np.zeros(alphabet[-1] + 1, kind)
    number[alphabet] = np.arange(len(alphabet))
    blank = number[BLANK]
    before = np.full(ORDER - 1 - (low - start), blank, kind)
    dense = np.concatenate([before, number[symbols[start:high]]])
    codes = dense[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        own = dense[ORDER - 1 - back : len(dense) - back]
        codes |= np.where(since[low:high] < back, blank, own) << kind(bits * back)
    yield low, high, codes, alphabet, bits


def _spelled(codes: np.ndarray, alphabet: np.ndarray, bits: int) -> np.ndarray:
    """The symbols of packed n-grams, a row each."""
    mask = codes.dtype.type((1 << bits) - 1)
    shift = [codes.dtype.type(bits * back) for back in range(ORDER - 1, -1, -1)]
    return np.stack([alphabet[(codes >> by) & mask] for by in shift], 1).astype(np.uint32)


def _keys(grams: np.ndarray, lang: str) -> np.ndarray:
    """64-bit hashes of a language's n-grams, alike in every task."""
    h = np.full(len(grams), xxhash.xxh64_intdigest(lang), np.uint64)
    for column in grams.T:
        h = mixed(h ^ (column.astype(np.uint64) + np.uint64(1)) * ODD)
    return h


def _ngrams(batch: pa.RecordBatch, symbols: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
    """``(lang, places, codes, alphabet, bits)`` of a block's symbols, language by language."""
    since = np.arange(len(symbols)) - np.repeat(first[:-1], np.diff(first))
    names, lang_of = np.unique(batch.column("lang").to_pylist(), return_inverse=True)
    own = np.repeat(lang_of.astype(np.int32), np.diff(first))
    for low, high, codes, alphabet, bits in _packed(symbols, since, 0, len(symbols)):
        for i in np.unique(own[low:high]).tolist():
            places = np.flatnonzero(own[low:high] == i)
            yield str(names[i]), places + low, codes[places], alphabet, bits


# Counting


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, gram, n)`` of all texts of a task, added up before they leave it."""
    kept, rows = [], 0
    for batch in blocks(batches, limit=BLOCK_BYTES):
        for lang, _, codes, alphabet, bits in _ngrams(batch, *_symbols(*text_buffer(batch.column("text")))):
            codes.sort()
            begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            grams = _spelled(codes[begin], alphabet, bits)
            n = np.diff(np.append(begin, len(codes)))
            kept.append((np.full(len(n), lang, object), _keys(grams, lang), grams, n))
            rows += len(n)
        if rows > 2 * PENDING:
            kept = [_added(kept)]
            rows = len(kept[0][1])
            if rows > PENDING:
                yield _counted(*kept[0])
                kept, rows = [], 0
    if kept:
        yield _counted(*_added(kept))


def _added(kept: list[tuple]) -> tuple:
    """Counts of equal n-grams added up."""
    lang, keys, grams, n = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    own = order[begin]
    return lang[own], keys[begin], grams[own], np.add.reduceat(n[order], begin)


def _counted(lang: np.ndarray, _: np.ndarray, grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    spelled = np.ascontiguousarray(grams).view(f"<U{ORDER}").reshape(-1)
    return pa.record_batch(
        [pa.array(lang, pa.string()), pa.array(spelled, pa.string()), pa.array(n, pa.int64())],
        ["lang", "gram", "n"],
    )


# The model


def _discounts() -> list[Column]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from counts of counts."""
    n1, n2, n3, n4 = (F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    known = (n1 > 0) & (n2 > 0)
    within = lambda d, high: F.when(known, F.least(F.greatest(d, F.lit(0.05)), F.lit(high))).otherwise(0.5)
    return [
        within(1 - 2 * y * F.try_divide(n2, n1), 0.95).alias("d1"),
        within(2 - 3 * y * F.try_divide(n3, n2), 1.9).alias("d2"),
        within(F.coalesce(3 - 4 * y * F.try_divide(n4, n3), F.lit(1.5)), 2.9).alias("d3"),
    ]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``(lang, gram, n, logp)`` from the counts ``(lang, gram, n)`` of n-grams of ORDER symbols.

    ``logp`` is the log probability of an n-gram's last symbol after the others. Shorter
    n-grams count the different symbols they follow; below single symbols all are equally
    likely, an unseen one among them. Windows are over the symbols that follow a context.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        tail = F.substring("gram", 2, order).alias("gram")
        shorter = tables[order + 1].groupBy("lang", tail).agg(F.count(F.lit(1)).alias("n"))
        tables[order] = save(shorter, "shorter").frame
    below = None
    for order in range(1, ORDER + 1):
        known = tables[order].groupBy("lang").agg(
            *_discounts(), (1 / (F.count(F.lit(1)) + 1)).alias("even")
        )
        taken = F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d1"))
        after = Window.partitionBy("lang", F.substring("gram", 1, order - 1))
        rows = tables[order].join(known, "lang").withColumn("taken", taken)
        rows = rows.withColumn("total", F.sum("n").over(after)).withColumn("left", F.sum("taken").over(after))
        if below is None:
            rows = rows.withColumn("shorter", F.col("even"))
        else:
            behind = below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("shorter"))
            rows = rows.withColumn("tail", F.substring("gram", 2, order - 1)).join(behind, ["lang", "tail"])
        p = (F.col("n") - F.col("taken") + F.col("left") * F.col("shorter")) / F.col("total")
        below = rows.select("lang", "gram", "n", p.alias("p"))
        if order < ORDER:
            below = save(below, "probabilities").frame
    return below.select("lang", "gram", "n", F.log("p").alias("logp"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, n, logp)`` of the rows of a model."""
    for batch in batches:
        spelled = np.array(batch.column("gram").to_pylist(), f"<U{ORDER}")
        grams = spelled.view(np.uint32).reshape(-1, ORDER)
        lang = np.array(batch.column("lang").to_pylist(), object)
        keys = np.empty(len(lang), np.uint64)
        for name in set(lang.tolist()):
            mine = lang == name
            keys[mine] = _keys(grams[mine], name)
        yield pa.record_batch(
            [pa.array(keys.view(np.int64)), batch.column("n"), batch.column("logp")], ["key", "n", "logp"]
        )


def ngram_model(documents: DataFrame) -> Saved:
    """``(key, n, logp)`` of all n-grams of all languages, sorted by key and in ranges of it."""
    counted = documents.select(_lang(), "text").mapInArrow(_counts, "lang string, gram string, n long")
    counts = save(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams").frame
    hashed = kneser_ney(counts).mapInArrow(_hashed, "key long, n long, logp double")
    return save(hashed.repartitionByRange("key").sortWithinPartitions("key"), "model")


def _head(model: DataFrame, head: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent n-grams of a model, at most ``head``, and the others."""
    size = F.floor(F.log2("n") * 16)
    sizes = model.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, room = None, head
    for row in sorted(sizes, key=lambda r: -r["size"]):
        room -= row["rows"]
        if room < 0:
            break
        least = row["size"]
    common = F.lit(False) if least is None else size >= least
    return model.filter(common), model.filter(~common)


class Frequent:
    """Looks n-grams up in the sorted hashes of the most frequent."""

    def __init__(self, keys: bytes, logp: bytes):
        self.keys, self.logp = np.frombuffer(keys, "<u8"), np.frombuffer(logp, "<f8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The log probabilities; NaN for others."""
        if not len(self.keys):
            return np.full(len(keys), np.nan)
        slot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[slot] == keys, self.logp[slot], np.nan)


# Scoring


def _repeat_words(words, hashes: np.ndarray) -> np.ndarray:
    """Per text the words in 3-word windows found twice or more in it."""
    text = words.text_of()
    runs = run_hashes(hashes, 3)
    at = np.flatnonzero(words.left()[: len(runs)] >= 3)
    key = mixed(runs[at] ^ mixed(text[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(text), bool)
    for i in range(3):
        covered[at[twice] + i] = True
    return np.bincount(text[covered], minlength=len(words.first) - 1)


def _repeat_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def _within(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text how many of its bytes are marked."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), at))


def _scores(batches: Iterator[pa.RecordBatch], keys: bytes, logp: bytes) -> Iterator[pa.RecordBatch]:
    """Counts of each text, the sum of its frequent n-grams' ``logp``, and its other n-grams."""
    frequent, row = Frequent(keys, logp), TaskContext.get().partitionId() << 33
    for batch in blocks(batches, limit=BLOCK_BYTES):
        carried = [c for c in batch.schema.names if c != "text"]
        data, at = text_buffer(batch.column("text"))
        words = split_words(data, at, BLANK_PARTED)
        raw = data.tobytes()
        symbols, first = _symbols(data, at)
        score, rare, rare_keys = np.zeros(len(symbols)), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for lang, places, codes, alphabet, bits in _ngrams(batch, symbols, first):
            distinct, which = np.unique(codes, return_inverse=True)
            own = _keys(_spelled(distinct, alphabet, bits), lang)
            value = frequent.find(own)
            score[places] = np.nan_to_num(value)[which]
            missed = np.flatnonzero(np.isnan(value)[which])
            rare.append(places[missed])
            rare_keys.append(own[which[missed]])
        place, key = np.concatenate(rare), np.concatenate(rare_keys)
        by = np.argsort(place)
        total = np.concatenate([[0.0], np.cumsum(score)])
        lists = np.searchsorted(place[by], first)
        lines = [_repeat_lines(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        counts = {
            "row": np.arange(row, row + batch.num_rows),
            "n_words": words.counts,
            "word_chars": _within(BLANK_PARTED[data] & ((data & 0xC0) != 0x80), at),
            "n_symbols": _within(_IS_MARK[data], at),
            "n_dup_lines": np.array(lines),
            "n_repeat_words": _repeat_words(words, word_hashes(words)),
            "length": np.diff(first),
        }
        row += batch.num_rows
        yield pa.record_batch(
            [
                *(batch.column(c) for c in carried),
                *(pa.array(x, pa.int64()) for x in counts.values()),
                pa.array(total[first[1:]] - total[first[:-1]], pa.float64()),
                pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(key[by].view(np.int64))),
            ],
            [*carried, *counts, "logp", "rare"],
        )


_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(MARKS)] = True


def _bands(scored: DataFrame, below: float, above: float) -> DataFrame:
    """``(lang, low, high)`` from the median and the median deviation of a language.

    Both are exact to a step of 1 / STEPS: they come from counts per step, of which a
    language has a bounded number. Where more than half of the documents are at one step the
    median deviation is zero, and the mean deviation takes its place.
    """
    step = F.round(F.col("log_perplexity") * STEPS).cast("int")
    filled = scored.filter("log_perplexity IS NOT NULL")
    steps = save(filled.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n")), "steps").frame
    middle = steps.groupBy("lang").agg(F.percentile("step", 0.5, F.col("n")).alias("middle"))
    away = steps.join(middle, "lang").withColumn("away", F.abs(F.col("step") - F.col("middle")))
    usual, mean = F.percentile("away", 0.5, F.col("n")), F.sum(F.col("away") * F.col("n")) / F.sum("n")
    spread = away.groupBy("lang").agg(
        F.first("middle").alias("middle"), F.when(usual > 0, usual).otherwise(mean).alias("spread")
    )
    # Half a step more, as the middle is rounded to steps.
    reach = lambda times: F.col("spread") * times + 0.5
    return spread.select(
        "lang",
        ((F.col("middle") - reach(below)) / STEPS).alias("low"),
        ((F.col("middle") + reach(above)) / STEPS).alias("high"),
    )


def _lang() -> Column:
    return F.coalesce("lang", F.lit("")).alias("lang")


def _scored(documents: DataFrame, head: int) -> DataFrame:
    """Counts and log perplexity of all documents."""
    spark = documents.sparkSession
    common, others = _head(ngram_model(documents).frame, head)
    table = common.select("key", "logp").toArrow()
    keys, logp = np.asarray(table["key"], np.int64).view(np.uint64), np.asarray(table["logp"], np.float64)
    by = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[by].tobytes(), logp[by].tobytes()))

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, text_key long, text_key2 long, lang string, row long, n_words long,"
        " word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, length long,"
        " logp double, rare array<long>"
    )
    plain = documents.select("doc_id", *_text_keys(), _lang(), "text")
    # The table fixes the numbers of its rows.
    found = save(plain.mapInArrow(lambda batches: _scores(batches, *shared.value), schema), "scores").frame
    rare = found.select("row", F.explode("rare").alias("key"))
    summed = rare.join(others, "key").groupBy("row").agg(F.sum("logp").alias("more"))
    whole = found.drop("rare").join(summed, "row", "left")
    score = -(F.col("logp") + F.coalesce("more", F.lit(0.0))) / F.nullif("length", F.lit(0))
    return save(whole.withColumn("log_perplexity", score).drop("row", "more", "logp", "length"), "perplexities").frame


def _text_keys() -> list[Column]:
    return [F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(1), "text").alias("text_key2")]


def _judged(documents: DataFrame, below: float, above: float, head: int) -> DataFrame:
    scored = _scored(documents, head)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return (
        scored.join(_bands(scored, below, above), "lang", "left")
        .withColumn("base_failed", base_failed)
        .withColumn("perplexity", F.exp("log_perplexity"))
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("log_perplexity")
    )


def judge_quality(
    documents: DataFrame, below: float = BELOW, above: float = ABOVE, head: int = HEAD
) -> DataFrame:
    """One row per document row with its counts, perplexity and verdict.

    Returns ``doc_id``, ``text_key`` (XXH64 of the text), ``lang``, ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``perplexity`` per symbol, the band ``low`` to ``high`` of its logarithm, and ``kept``:
    neither failed on the base rules nor out of the band. ``below`` and ``above`` set how
    many median deviations wide a band is on either side.

    A null text has no words and fails the base rules; it has no perplexity. Documents
    without a language are a language of their own, named ''. Repeated rows each count and
    get a row. Other columns are ignored; an empty table gives an empty one. At most
    ``head`` n-grams are sent to the tasks, whatever their number; results are the same.
    N-grams are told apart by 64-bit hashes.
    """
    return _judged(documents, below, above, head).drop("text_key2")


def keep_good(
    documents: DataFrame, below: float = BELOW, above: float = ABOVE, sent: int = SENT_TEXTS
) -> DataFrame:
    """The rows of ``documents`` that ``judge_quality`` keeps; columns as they were.

    The verdict depends on text and language alone. Up to ``sent`` rejected texts are sent to
    the tasks, as two hashes each, so that texts are not shuffled; more are joined.
    """
    keys = ["lang", "text_key", "text_key2"]
    bad = _judged(documents, below, above, HEAD).filter(~F.col("kept"))
    rejected = save(bad.select(*keys).distinct(), "rejected")
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    keyed = documents.select(whole.alias("row"), _lang(), *_text_keys())
    listed = F.broadcast(rejected.frame) if rejected.rows <= sent else rejected.frame
    return keyed.join(listed, keys, "left_anti").select("row.*")
