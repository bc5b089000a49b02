"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockscan.llm.decontaminate import find_contamination
from flockscan.llm.line_runs import remove_repeated_runs
from flockscan.llm.manifest import merkle_manifest
from flockscan.llm.mixing import plan_mixture
from flockscan.llm.perplexity import judge_quality
from flockscan.llm.quality import classify_quality
from flockscan.llm.simhash import near_duplicates
from flockscan.llm.substrings import remove_repeats
from flockscan.llm.token_counts import count_tokens
from flockscan.llm.token_files import read_token_files, write_token_files
from flockscan.llm.urls import judge_urls
from flockscan.llm.warc import read_archives, write_archives
from flockscan.llm.whitening import whiten
from flockscan.storage import new_path

# The rules that op3 is to apply.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


def tokenizer_definition() -> str:
    """The public byte-level BPE as JSON text, read by the driver alone."""
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")


def op2_token_files(spark, sf_dir):
    path = new_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_definition())
    return read_token_files(spark, path)


def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_line_runs(spark, sf_dir):
    cut = remove_repeated_runs(_table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    )


def op5_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path, with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mixing(spark, sf_dir):
    plan = plan_mixture(_table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id",
        "source",
        "n_tokens",
        F.round("exponent", 9).alias("exponent"),
        F.round("weight", 9).alias("weight"),
        "budget",
        "block",
        "copies",
    )


def op7_quality_rules(spark, sf_dir):
    judged = judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("perplexity", 6).alias("perplexity"),
    )


def op8_decontamination(spark, sf_dir):
    documents, benchmark = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = find_contamination(documents, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_substring_dedup(spark, sf_dir):
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_classifier(spark, sf_dir):
    judged = classify_quality(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "pattern", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "kept"
    )


def op11_whitening(spark, sf_dir):
    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    # Wider than a long, so that adding to the largest one is no error.
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    proved = merkle_manifest(
        documents,
        ["doc_id", "source", "lang", "n_chars", "text"],
        altered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
        changed={"n_chars": more},
    )
    siblings = F.flatten(F.transform("proof", lambda step: F.array(step["left"], step["right"])))
    return proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_token_counts(spark, sf_dir):
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_definition())


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_files": op2_token_files,
    "op3_url_filter": op3_url_filter,
    "op4_line_runs": op4_line_runs,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_counts": op13_token_counts,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# Five bits at a time from the hex digits of a digest.
_BASE32_SQL = """list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
            (CAST('0x' || substr(h, 1 + 5 * i // 4, 2) AS INTEGER) >> (3 - 5 * i % 4)) & 31), 1)
            FOR i IN range(32)], 'string_agg', '')"""


# CRC-32 of a decimal number, bit by bit: each byte enters, then eight shifts.
_CRC32_SQL = """xor(list_reduce(flatten([[CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]
            FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
            lambda crc, byte: xor(xor(crc, byte) >> 1, (xor(crc, byte) & 1) * 3988292384),
            CAST(4294967295 AS BIGINT)), 4294967295)"""


def _leaf_sql(n_chars: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def _fold_sql(nodes: str, tree: str) -> str:
    """One level up: the digest with its sibling, and the proof so far."""
    return f"""
            SELECT f.doc_id, f.tree, f.level + 1, f.place // 2,
                sha256(CASE WHEN s.digest IS NULL THEN f.digest
                    WHEN f.place % 2 = 0 THEN f.digest || s.digest ELSE s.digest || f.digest END),
                f.proof || coalesce(s.digest, ''), (f.n + 1) // 2
            FROM f LEFT JOIN {nodes} s
                ON s.tree = {tree} AND s.level = f.level AND s.place = xor(f.place, 1)
            WHERE f.n > 1"""


def mixing_sql(documents: str) -> str:
    """Rows of ``plan_mixture`` over the named table, with whole columns of it beside them."""
    draw = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
    return f"""
        counted AS (
            SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens
            FROM {documents}
        ),
        totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS total FROM counted GROUP BY source),
        ends AS (SELECT max(total) / min(total) AS ratio, sum(total) AS every, max(total) AS most FROM totals),
        halved(step, low, high) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
            UNION ALL
            SELECT step + 1, CASE WHEN ratio ** (1 - (low + high) / 2) > 2 THEN (low + high) / 2 ELSE low END,
                CASE WHEN ratio ** (1 - (low + high) / 2) > 2 THEN high ELSE (low + high) / 2 END
            FROM halved, ends WHERE step < 48
        ),
        exponent AS (
            SELECT CASE WHEN ratio > 2 THEN high ELSE 0.0::DOUBLE END AS exponent FROM halved, ends WHERE step = 48
        ),
        norm AS (SELECT sum((total / every) ** exponent) AS norm FROM totals, ends, exponent),
        weights AS (
            SELECT source, total, exponent, (total / every) ** exponent / norm AS weight,
                CAST(round((total / every) ** exponent / norm * most / ((most / every) ** exponent / norm)) AS BIGINT)
                    AS budget,
                greatest(CAST(ceil(total / 262144) AS BIGINT), 1) AS blocks
            FROM totals, ends, exponent, norm
        ),
        placed AS (
            SELECT counted.*, exponent, weight, budget, budget // total AS passes, budget % total AS rest,
                {draw.format("'block:' || doc_id")} % blocks AS block
            FROM counted JOIN weights USING (source)
        ),
        sized AS (
            SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS size, first(rest) AS rest
            FROM placed GROUP BY source, block
        ),
        ordered AS (
            SELECT source, block, size, rest - coalesce(sum(size) OVER (
                PARTITION BY source ORDER BY {draw.format("'order:' || source || ':' || block")}, block
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wanted
            FROM sized
        ),
        begun AS (
            SELECT placed.*, wanted, size, coalesce(sum(n_tokens) OVER (
                PARTITION BY source, block ORDER BY md5(CAST(doc_id AS VARCHAR))
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
            FROM placed JOIN ordered USING (source, block)
        ),
        planned AS (
            SELECT *, CASE WHEN n_tokens = 0 THEN 1 ELSE CAST(passes + CASE
                WHEN wanted <= 0 THEN 0 WHEN wanted >= size THEN 1 WHEN begun < wanted THEN 1 ELSE 0 END AS INTEGER)
                END AS copies
            FROM begun
        )"""


ORACLE_SQL = {
    "op4_line_runs": """
        WITH lines AS (
            SELECT doc_id, lines, len(lines) AS n FROM (
                SELECT doc_id, coalesce(string_split(text, chr(10)), []) AS lines FROM documents
            )
        ),
        runs AS (
            SELECT doc_id, i, array_to_string(lines[i : i + 2], chr(10)) AS w
            FROM (SELECT doc_id, lines, unnest(range(1, n - 1)) AS i FROM lines WHERE n >= 3)
        ),
        ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM runs),
        places AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS place FROM ranked WHERE k > 1),
        gone AS (SELECT doc_id, list(place) AS gone FROM places GROUP BY doc_id)
        SELECT doc_id, n AS n_lines, coalesce(len(gone), 0) AS n_removed,
            sha256(array_to_string(CASE WHEN gone IS NULL THEN lines ELSE
                list_transform(list_filter(list_zip(lines, range(1, n + 1)),
                    lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, chr(10))) AS kept_sha256
        FROM lines LEFT JOIN gone USING (doc_id)""",
    "op6_mixing": f"""
        WITH RECURSIVE {mixing_sql("documents")}
        SELECT doc_id, source, n_tokens, round(exponent, 9) AS exponent, round(weight, 9) AS weight,
            budget, block, copies
        FROM planned""",
    "op5_warc": f"""
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ),
        named AS (
            SELECT page_id, payload_bytes, {_BASE32_SQL} AS payload_digest,
                max(page_id) OVER (PARTITION BY h) AS first
            FROM payloads
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM named""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE
        leaves AS (
            SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
                CASE WHEN {_CRC32_SQL} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql("n_chars")} END AS claim
            FROM documents
        ),
        placed AS (
            SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place,
                count(*) OVER (PARTITION BY lang) AS n
            FROM leaves
        ),
        nodes(tree, level, place, digest, n) AS (
            SELECT tree, 0, place, leaf, n FROM placed
            UNION ALL
            SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2
            FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2
        ),
        subroots AS (SELECT tree, digest AS subroot FROM nodes WHERE n = 1),
        heads(tree, level, place, digest, n) AS (
            SELECT 0, 0, tree, subroot, (SELECT count(*) FROM subroots) FROM subroots
            UNION ALL
            SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + 1) // 2
            FROM heads WHERE n > 1 GROUP BY tree, level, place // 2
        ),
        f(doc_id, tree, level, place, digest, proof, n) AS (
            SELECT doc_id, tree, 0, place, claim, '', n FROM placed
            UNION ALL {_fold_sql("nodes", "f.tree")}
        ),
        g(doc_id, tree, level, place, digest, proof, n) AS (
            SELECT doc_id, tree, 0, tree, digest, proof, (SELECT count(*) FROM subroots) FROM f WHERE n = 1
            UNION ALL {_fold_sql("heads", "0").replace("f.", "g.").replace("FROM f", "FROM g")}
        )
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
        FROM g JOIN leaves USING (doc_id) JOIN subroots USING (tree)
            JOIN (SELECT digest AS root FROM heads WHERE n = 1) ON true
        WHERE n = 1""",
    "op3_url_filter": f"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
        cut AS (
            SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', ['host', 'path']),
                {{'host': '', 'path': ''}}) AS a
            FROM pages
        ),
        parts AS (SELECT page_id, translate(a.host, {_A_Z}) AS host, a.path AS path FROM cut),
        fits AS (
            SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM parts, rules
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts LEFT JOIN fits USING (page_id)""",
    "op8_decontamination": f"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(translate(text, {_A_Z}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
            FROM documents
        ),
        items AS (
            SELECT item_id, regexp_extract_all(translate(text, {_A_Z}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words
            FROM benchmark
        ),
        windows AS (
            SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS w
            FROM (
                SELECT item_id, words, least(len(words), 10) AS size,
                    unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
                FROM items WHERE len(words) > 0
            )
        ),
        sizes AS (SELECT DISTINCT size FROM windows),
        runs AS (
            SELECT doc_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS w
            FROM (
                SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
                FROM texts, sizes WHERE len(words) >= size
            )
        ),
        hits AS (SELECT doc_id, size, i, item_id FROM runs JOIN windows USING (size, w)),
        places AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS place FROM hits),
        covered AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
        named AS (
            SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id
        )
        SELECT doc_id, coalesce(len(words), 0) AS n_words, coalesce(n_hit, 0) AS n_hit,
            coalesce(len(ids), 0) AS n_items,
            sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_substring_dedup": """
        WITH texts AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
        ),
        windows AS (
            SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS w
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM texts WHERE len(words) >= 20)
        ),
        ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows),
        places AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM ranked WHERE n > 1),
        gone AS (SELECT doc_id, list(place) AS gone FROM places GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
            sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
                list_transform(list_filter(list_zip(words, range(1, len(words) + 1)),
                    lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
        FROM texts LEFT JOIN gone USING (doc_id)""",
}
