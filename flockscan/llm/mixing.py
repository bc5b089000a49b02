"""Mixing sources by temperature, realised as budgeted block permutations.

A source with share p of all tokens is given the weight p^a, normalised. The exponent a is
bisected: down to the flattest mixture that repeats no source more often than a limit, or
to a target entropy. A source's budget of tokens is met by whole passes over it and, for
the rest, by its blocks in a random order, the last of them cut between two documents.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockscan.llm.words import spare_name
from flockscan.storage import save

REPETITION_LIMIT = 2.0
BLOCK_TOKENS = 1 << 18
HALVINGS = 48
WORD = r"[^\x20\x09-\x0D]+"


def count_tokens(text: Column) -> Column:
    """Words parted by ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*values: Column) -> Column:
    """A number from 0 to 2^32 - 1, the same in every run."""
    text = F.concat_ws(":", *(v.cast("string") for v in values))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _fold(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, p: total + term(p))


def _exponent(shares: Column, limit: float | None, entropy: float | None) -> Column:
    """The exponent between 0 and 1, halving the interval ``HALVINGS`` times.

    Repetition is counted at the least budget that uses every source once, so it is the
    ratio of the largest to the smallest share to the power 1 - a; it falls as a grows,
    and so does the entropy.
    """
    if (limit is None) == (entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    ratio = F.array_max(shares) / F.array_min(shares)

    def too_flat(a: Column) -> Column:
        if limit is not None:
            return F.pow(ratio, 1 - a) > limit
        norm = _fold(shares, lambda p: F.pow(p, a))
        mean = _fold(shares, lambda p: F.pow(p, a) * a * F.ln(p))
        return F.ln(norm) - mean / norm > entropy

    def halve(ends: Column, _: Column) -> Column:
        middle = (ends["low"] + ends["high"]) / 2
        return F.struct(
            F.when(too_flat(middle), middle).otherwise(ends["low"]).alias("low"),
            F.when(too_flat(middle), ends["high"]).otherwise(middle).alias("high"),
        )

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(HALVINGS))
    found = F.aggregate(steps, start, lambda ends, i: halve(ends, i))["high"]
    return F.when(too_flat(F.lit(0.0)), found).otherwise(0.0)


def source_weights(
    totals: DataFrame, limit: float | None = REPETITION_LIMIT, entropy: float | None = None
) -> DataFrame:
    """``(source, n_tokens, share, exponent, weight, budget)`` from ``(source, n_tokens)``.

    ``entropy`` in nats. The budgets add up to the least number of tokens at which no
    source falls short of one whole pass. Sources without tokens get weight 0.
    """
    filled = totals.filter("n_tokens > 0")
    # One number per source.
    row = filled.agg(F.sort_array(F.collect_list("n_tokens")).alias("sizes"))
    row = row.select("sizes", F.aggregate("sizes", F.lit(0).cast("long"), lambda t, n: t + n).alias("all"))
    shares = F.transform("sizes", lambda n: n / F.col("all"))
    row = row.select("all", shares.alias("shares")).withColumn("exponent", _exponent(F.col("shares"), limit, entropy))
    row = row.withColumn("norm", _fold(F.col("shares"), lambda p: F.pow(p, F.col("exponent"))))
    # The largest share is repeated least.
    top = F.pow(F.array_max("shares"), F.col("exponent")) / F.col("norm")
    row = row.withColumn("budget_all", F.array_max("shares") * F.col("all") / top).drop("shares")
    share = F.coalesce(F.try_divide("n_tokens", "all"), F.lit(0.0))
    weight = F.when(F.col("n_tokens") > 0, F.pow(share, F.col("exponent")) / F.col("norm")).otherwise(0.0)
    return (
        totals.crossJoin(F.broadcast(row))
        .withColumns({"share": share, "weight": weight})
        .withColumn("budget", F.round(F.col("weight") * F.col("budget_all")).cast("long"))
        .select("source", "n_tokens", "share", "exponent", "weight", "budget")
    )


def _begun(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` with ``begun``, the sum of ``value`` over the earlier rows of their source.

    A range sort spreads a source over partitions, so that no task holds a whole one; what
    the earlier partitions add up to is a row for each source and partition.
    """
    sorted_rows = rows.orderBy("source", *order).withColumn("place", F.monotonically_increasing_id())
    # The id keeps the partition above bit 33.
    placed = save(sorted_rows.withColumn("part", F.shiftright("place", 33)), name).frame
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("source", "part").agg(F.sum(value).alias("total"))
    parts = parts.select("source", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.col("base") + F.coalesce(F.sum(value).over(within), F.lit(0))
    return placed.join(parts, ["source", "part"]).withColumn("begun", begun).drop("part", "place", "base")


def plan_mixture(
    documents: DataFrame,
    limit: float | None = REPETITION_LIMIT,
    entropy: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """How often each row of ``documents`` is used, by the weights of its source.

    Returns ``doc_id``, ``text_key`` (XXH64 of the text), ``source``, ``n_tokens``,
    ``exponent``, ``weight``, ``budget`` of the source, ``block`` and ``copies``. A document
    of the last block belongs to the rest if it begins within the budget.

    A null text has no tokens; without tokens a document is used once. Documents without a
    source are a source named ''. Repeated rows are counted and blocked each; rows with equal
    id, text and source are used alike, as often as the first of them. An equal ``doc_id``
    gives an equal block, rows without one are dealt by their text. Other columns are
    ignored; an empty table gives an empty one.
    """
    source = F.coalesce("source", F.lit(""))
    counted = documents.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        source.alias("source"),
        count_tokens(F.col("text")).alias("n_tokens"),
    )
    counted = save(counted, "token-counts").frame
    totals = save(counted.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")), "totals").frame
    weights = source_weights(totals, limit, entropy)
    passes = F.coalesce(F.expr("budget div nullif(n_tokens, 0)"), F.lit(1))
    weights = weights.withColumns(
        {
            "passes": passes,
            "rest": F.when(F.col("n_tokens") > 0, F.col("budget") % F.col("n_tokens")).otherwise(0),
            "blocks": F.greatest(F.ceil(F.col("n_tokens") / block_tokens), F.lit(1)),
        }
    )
    weights = save(weights.withColumnRenamed("n_tokens", "source_tokens"), "weights").frame

    # Rows without an id are dealt by their text, so that a crowd of them is no block of its own.
    doc = F.coalesce(F.col("doc_id").cast("string"), F.col("text_key").cast("string"), F.lit(""))
    placed = counted.join(weights, "source").withColumn("block", draw(F.lit("block"), doc) % F.col("blocks"))
    sizes = placed.groupBy("source", "block").agg(
        F.sum("n_tokens").alias("size"), F.first("rest").alias("rest")
    )
    # Blocks of a source in the order of a random draw, with the tokens before each.
    ordered = _begun(sizes, [draw(F.lit("order"), F.col("source"), F.col("block")), F.col("block")], "size", "order")
    # Tokens still wanted when a block begins: none, all of it or a part.
    left = F.col("rest") - F.col("begun")
    blocks = save(ordered.select("source", "block", "size", left.alias("left")), "blocks").frame
    joined = placed.join(blocks, ["source", "block"])
    # Where no tokens are, nothing is repeated.
    cut = (F.col("left") > 0) & (F.col("left") < F.col("size")) & (F.col("n_tokens") > 0)
    equal = ["source", "doc_id", "text_key"]
    within = joined.filter(cut).groupBy(*equal).agg(
        F.first("left").alias("left"), F.sum("n_tokens").alias("tokens")
    )
    within = _begun(within, [F.md5(doc), F.col("text_key")], "tokens", "cut")
    within = within.select(*(F.col(c).alias(f"_{c}") for c in equal), (F.col("begun") < F.col("left")).alias("used"))
    same = F.lit(True)
    for c in equal:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    parts = [
        joined.filter(~cut).withColumn("more", (F.col("left") > 0).cast("int")),
        joined.filter(cut).join(within, same).withColumn("more", F.col("used").cast("int")),
    ]
    copies = F.when(F.col("n_tokens") == 0, 1).otherwise(F.col("passes") + F.col("more")).cast("int")
    found = ["doc_id", "text_key", "source", "n_tokens", "exponent", "weight", "budget", "block"]
    every, some = (part.select(*found, copies.alias("copies")) for part in parts)
    return every.unionByName(some)


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with each row as often as ``plan_mixture`` says; columns as they were."""
    plan = plan_mixture(documents, **options)
    # Equal rows are used alike: if the cut falls between them, each as often as the first.
    times = plan.groupBy("doc_id", "text_key", "source").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")
    )
    copies, copy = spare_name(documents, "copies"), spare_name(documents, "copy")
    named = save(
        times.select(
            F.col("doc_id").alias("_id"),
            F.col("text_key").alias("_key"),
            F.col("source").alias("_source"),
            F.ceil(F.col("copies") / F.col("rows")).cast("int").alias(copies),
        ),
        "copies",
    ).frame
    own = (
        documents["doc_id"].eqNullSafe(named["_id"])
        & F.xxhash64(documents["text"]).eqNullSafe(named["_key"])
        & (F.coalesce(documents["source"], F.lit("")) == named["_source"])
    )
    # With fewer copies than rows none may be left; a sequence from 1 to 0 would count down.
    found = documents.join(named.filter(F.col(copies) > 0), own)
    used = found.select(*(documents[c] for c in documents.columns), named[copies])
    return used.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*documents.columns)
