"""A training corpus from raw documents: good text, without repeated lines, near copies and benchmark items, as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, line_dedup, near_dups, quality, templates
from tidelog.llm.common import prepare, table
from tidelog.llm.queries import read, tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of their language accepts."""
    judged = quality.classify(docs, read(prepare(spark), sf_dir, "labels"))
    return judged.filter("__keep").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less repeated lines; those whose every line of any content was a repeat go. ``n_chars``, if there, is counted anew.

    A null text stays; so does one that was blank before. Rows equal in id and text lose the same lines.
    """
    prepare(spark)
    left = line_dedup.deduplicate_lines(docs)
    empty = (F.col("__n_removed") > 0) & ~F.col("text").rlike("\\S")
    left = left.filter(~empty).select(docs.columns)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    prepare(spark)
    return near_dups.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return templates.decontaminate(docs, read(prepare(spark), sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document's text."""
    prepare(spark)
    encoded = bpe.encode(docs, tokenizer_file())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding", to_tokens),
]

# The language model, signatures and merges have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet before the next."""
    docs = read(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
