"""Corpus sources (scan, counts, slice, cap) and the article adapter.

The working corpus shape is ``(lang string, idx bigint, title string,
text string)``: one DataFrame for every language, ``lang`` a column, ``idx``
the stable row identity given by the source (never generated).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CHUNK_ROWS
from ..functions.text import derived_title
from ..operators.ranking import group_positions
from ..session import ensure_checkpoint_dir, table_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """Adapt ``documents(doc_id, text, lang, ...)`` to the corpus shape.

    The table carries no title; the adapter derives one from the first
    paragraph (see ``derived_title``). ``idx`` is ``doc_id``.
    """
    return documents.select(
        F.col("lang"),
        F.col("doc_id").cast("bigint").alias("idx"),
        derived_title("text").alias("title"),
        F.col("text"),
    )


def corpus_scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a corpus that already has ``lang, idx, title, text`` columns."""
    return spark.read.format(fmt).load(path).select("lang", "idx", "title", "text")


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread rows when the scan yields fewer splits than the cluster has cores.

    A file of one large row group is one task, whatever the split size, and
    per-row text work (regexes, Python inference) would run on one core. Only
    the placement of rows changes, never a result. An input with many splits is
    read as it is, without a shuffle.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def load_corpus(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """The corpus of a table folder; ``spread=False`` where no per-row text work follows."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return corpus_from_documents(ensure_parallelism(documents) if spread else documents)


def bucket_corpus(corpus: DataFrame, buckets: int | None = None) -> DataFrame:
    """The corpus written once as a table bucketed by ``(lang, idx)``, the key of all lookups.

    Lookups by selection, members and top clusters (and of the texts for entropy) then move
    only their narrow side; the corpus stays where it is. ``buckets`` (by default the
    session's shuffle partitions; fewer than those and the planner shuffles after all)
    is one file each, below the checkpoint folder, deleted when the driver ends.
    """
    spark = corpus.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tessera_corpus_{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    # dealt out as the buckets are, so a task writes its bucket and no other
    rows = corpus.repartition(n, "lang", "idx")
    rows.write.format("parquet").bucketBy(n, "lang", "idx").sortBy("lang", "idx").option("path", folder).saveAsTable(name)
    return spark.table(name)


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """Rows per language (partial aggregation, one tiny shuffle)."""
    return corpus.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))


def corpus_slice(corpus: DataFrame, start_idx: int, end_idx: int) -> DataFrame:
    """Rows with ``start_idx <= idx < end_idx``; pushed down to the scan.

    The range must be non-empty and must not begin below 0; an end beyond the
    data simply selects to the end.
    """
    if not 0 <= start_idx < end_idx:
        raise ValueError(f"not a row range: [{start_idx}, {end_idx})")
    return corpus.where((F.col("idx") >= start_idx) & (F.col("idx") < end_idx))


def chunk_start(idx_col: str = "idx", chunk_rows: int = CHUNK_ROWS):
    return (F.floor(F.col(idx_col) / chunk_rows) * chunk_rows).cast("bigint")


def slice_counts(corpus: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of every ``[start, start + chunk_rows)`` slice, per language."""
    return corpus.groupBy("lang", chunk_start("idx", chunk_rows).alias("slice_start")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def corpus_cap(corpus: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` rows of every language, counted by position in ``idx`` order.

    Opt-in: no stage applies it unless asked to. Positions come from a narrow
    table (language and idx), so no language meets in one task; rows of equal
    ``idx`` share one fate.
    """
    keys = corpus.select("lang", "idx").distinct()
    first = group_positions(keys, ["lang"], ["idx"], pos_col="_pos", size_col=None).where(F.col("_pos") < cap).drop("_pos")
    same = corpus["lang"].eqNullSafe(first["lang"]) & corpus["idx"].eqNullSafe(first["idx"])
    return corpus.join(first, same, "left_semi")


def merge_order_key(idx_col: str = "idx", prefix: str = "selected_data_", chunk_rows: int = CHUNK_ROWS):
    """Sort key reproducing the original merge order of chunk files.

    Chunk files are concatenated in *lexicographic* file-name order, so the
    chunk starting at 100000 precedes the one at 20000. Ordering rows by
    ``(merge_order_key, idx)`` reproduces that concatenation order.
    """
    return F.concat(F.lit(prefix), chunk_start(idx_col, chunk_rows).cast("string"), F.lit(".json"))
