"""Incremental stage 1 with Structured Streaming.

Entity selection is a per-row function, so new article files can be selected
as they land: the same ``ner_records`` plan runs on a file stream and appends
to a language-partitioned sink. A running count of both routes per language
is kept as streaming state (``groupBy().count()``, update mode).

Checkpoints live under the cluster's ``spark.checkpoint.dir`` so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.entities import ner_records
from ..session import ensure_checkpoint_dir
from ..sources.corpus import corpus_from_documents
from ..sources.files import entities_to_pairs

DOCUMENTS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_documents_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(DOCUMENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def selection_stream(documents: DataFrame, recognizer=None) -> DataFrame:
    """Streaming stage-1 records (same plan as the batch stage)."""
    return ner_records(corpus_from_documents(documents), recognizer)


def _checkpoint(spark: SparkSession, name: str, location: str | None) -> str:
    return location or os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def start_selection_sink(
    records: DataFrame,
    out_dir: str,
    name: str = "ner_selection",
    checkpoint_location: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append both routes as Parquet partitioned by ``(selected, lang_code)``."""
    spark = records.sparkSession
    out = records.select("title", "index", entities_to_pairs().alias("entities"), "lang_code", "selected")
    w = (
        out.writeStream.format("parquet")
        .option("path", out_dir)
        .option("checkpointLocation", _checkpoint(spark, name, checkpoint_location))
        .partitionBy("selected", "lang_code")
        .outputMode("append")
        .queryName(name)
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def route_counts_stream(records: DataFrame) -> DataFrame:
    """Running ``(lang_code, selected, n)``; state is one row per key."""
    return records.groupBy("lang_code", "selected").agg(F.count(F.lit(1)).alias("n"))


def start_route_counts(
    records: DataFrame,
    name: str = "ner_route_counts",
    checkpoint_location: str | None = None,
    available_now: bool = True,
    sink: str = "memory",
) -> StreamingQuery:
    spark = records.sparkSession
    w = (
        route_counts_stream(records)
        .writeStream.format(sink)
        .queryName(name)
        .outputMode("complete")
        .option("checkpointLocation", _checkpoint(spark, name, checkpoint_location))
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
