"""URL filter: host-suffix and path-prefix expressions looked up by short hash prefixes.

Every URL stands for its expressions, each made of a suffix of its host's labels and a
prefix of its path. Only expressions as long as some rule are made, once per distinct
pair of host end and path head. They meet the rules in an equi-join on the first 32 bits
of their SHA-256; what meets is confirmed by the full digest, and the longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one pair of host end and path head are dealt over so many slices.
SLICES = 16
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A host holds no slash and a path is empty or starts with one.
    return F.sha2(F.concat(host, path), 256)


def _listed(rules: DataFrame) -> DataFrame:
    """One row per host and path; if verdicts differ, block wins."""
    host = lower_ascii(F.coalesce("host", F.lit("")))
    clean = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    one = clean.filter("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return one.select("*", digest.alias("digest"), F.substring(digest, 1, 8).alias("short"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules(host, path, verdict)`` with verdicts allow and block; a rule fits its host and
    all subdomains if the path starts with its path. The longest rule (host and path
    together, then host) wins; without one ``rule`` is null and ``verdict`` the default.

    A null URL, or one without ``://``, has an empty host and path and fits no rule. Rules
    without a host are ignored, a null path of a rule is empty; a rule listed twice with both
    verdicts blocks. Repeated rows stay. Columns already named like the four are replaced.
    """
    listed = _listed(rules)
    reach = listed.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)).alias("labels"),
        # As many numbers at most as the longest path of a rule has characters.
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()
    lengths = list(reach["lengths"]) or [0]

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    seen = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    tail = F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(reach["labels"])), reach["labels"]), ".")
    seen = seen.withColumns({"_tail": tail, "_head": F.substring("path", 1, max(lengths))})

    # Expressions of each distinct pair.
    parts = F.split("_tail", r"\.")
    spans = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("_head"))
    pairs = seen.select("_tail", "_head").filter("_tail <> ''").distinct()
    made = pairs.select("*", F.explode(spans).alias("suffix"), fits.alias("sizes"))
    made = made.select("_tail", "_head", "suffix", F.explode("sizes").alias("n"))
    made = made.withColumn("full", _digest(F.col("suffix"), F.expr("substring(_head, 1, n)")))
    met = made.withColumn("short", F.substring("full", 1, 8)).join(listed, "short")
    confirmed = met.filter(F.col("full") == F.col("digest"))
    order = F.struct(
        (F.length("host") + F.length("path")).alias("size"),
        F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    best = confirmed.groupBy("_tail", "_head").agg(F.max(order).alias("best"))
    spread = best.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))

    slice_of = F.pmod(F.xxhash64(F.col(url)), F.lit(SLICES)).cast("int")
    found = seen.withColumn("_slice", slice_of).join(spread, ["_tail", "_head", "_slice"], "left")
    return found.select(
        *kept,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
