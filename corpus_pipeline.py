"""From raw documents to packed training sequences, in five stages.

Every stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as Parquet
and read again as the next one's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontamination, language, line_dedup, near_dedup, packing
from tidewatch.llm.common import table_path
from tidewatch.llm.queries import tokenizer
from tidewatch.session import checkpoint_dir
from tidewatch.sources import folders


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and a main language; the model learns from the labelled documents of the corpus."""
    return language.identified(docs, language.fit(language.training_rows(docs)))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occurred before are cut out; a document of which nothing is left goes."""
    return line_dedup.without_repeats(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language", keep_identified),
    ("lines", cut_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("packing", pack_tokens),
]

# models and tokenizers cannot be said in SQL; the tests compare lines and near duplicates with plain versions, the rows that
# language and decontamination keep with the tested operators, and packing with the documents it gets
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between is written to the shared checkpoint folder.

    The result of a stage is removed when that of the next one is written; the last one's input stays, as the result reads it.
    """
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            folders.drop(spark, [f"{folder}/{before}"])
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
