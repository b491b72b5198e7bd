"""Corpus pipeline: language ID, line dedup, near dedup, decontamination, BPE.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``; what a stage rejects or removes
is gone for all later ones. Null texts have no letter and leave at the first
stage; an empty table passes through all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, langid, linededup, neardup
from tessera.llm.scratch import store
from tessera.session import table_path

#: A text that the best language model codes no shorter than eight bits a byte is explained by none.
MAX_BITS_PER_BYTE = 8.0


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled rows; the rest go."""
    return langid.keep_known(docs, langid.fit(docs), max_bits=MAX_BITS_PER_BYTE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; documents left without a word go."""
    return _sized(linededup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies."""
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean_documents(docs, spark.read.parquet(table_path(sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents left; ``round_trip`` says that decoding them gives the text."""
    coded = bpe.encode_texts(docs.select(F.struct("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")).alias("row"), "text"), "row")
    return coded.select(
        "row.doc_id",
        "row.lang",
        "row.source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("row.text_sha256")).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: Language models, b-bit sketches and merges are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
