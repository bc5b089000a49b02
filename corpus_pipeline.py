"""The corpus pipeline: documents to token files, in five stages.

Each stage is a function of ``(spark, docs, sf_dir)``. What it returns is written as
Parquet and read again as the next stage's documents. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flockscan.llm.decontaminate import drop_contaminated
from flockscan.llm.mixing import mixed_documents
from flockscan.llm.perplexity import keep_good
from flockscan.llm.queries import tokenizer_definition
from flockscan.llm.simhash import first_of_each
from flockscan.llm.token_files import read_token_files, write_token_files
from flockscan.storage import new_path, workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the base rules or lie out of their language's band go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: four-word shingles, fingerprints within 4 of 64 bits."""
    return first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is used once at least, those of small sources up to about twice."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written and read back: a row for each document in them."""
    path = new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_definition())
    return read_token_files(spark, path)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix),
    ("token files", tokenize),
]

# SimHash, the perplexity model and the tokenizer are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = new_path(spark, "stage")
        # What a stage stored on its way goes as soon as its result is written.
        with workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
