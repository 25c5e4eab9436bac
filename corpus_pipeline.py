"""From raw documents to a training mix: language, repeated passages, near copies, benchmark leaks, mixing.

Each stage takes the documents that the one before has kept and gives what it keeps, with the same columns; the last
adds how often the mix takes each document. The driver writes each stage's rows as Parquet and reads them again for
the next; run() does the same when it is called by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language, line_dedup, mixing, simhash
from tidemark.llm.common import shared_folder, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters, or between languages, go."""
    import public_tokenizers

    return language.keep_known(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that other documents have are taken out of all but the first; the length in n_chars follows the text."""
    return line_dedup.dedup_lines(docs, length_col="n_chars")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.keep_one_of_each(docs)


def without_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies and taken."""
    return mixing.take(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_passages),
    ("simhash", without_near_copies),
    ("decontamination", without_benchmark_leaks),
    ("mixing", mixed),
]

#: Models, automata and a knapsack are beyond SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written to the shared folder and read again. The rows that the last
    stage reads stay there, because the result is computed from them; those of the stages before are removed."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            # What is written no longer needs what it was made from.
            before = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{STAGES[k - 1][0]}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs
