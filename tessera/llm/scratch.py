"""Written tables between steps, and joins that broadcast only checked sizes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir

#: Rows of 8-byte keys that a broadcast may hold (about 16 MB raw, some 60 MB as a hash table).
BROADCAST_KEYS = 1_000_000

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def schema_with(id_type: T.DataType, rest: str) -> T.StructType:
    """``id`` of the given type (a struct of carried columns may be one), then the columns of the DDL ``rest``."""
    return T.StructType([T.StructField("id", id_type), *T._parse_datatype_string(rest).fields])


def packed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (every other column in one struct) and the text: an operator takes
    ``row`` as its id, so filtering needs no join back and no column name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(text_col))


def unpacked(df: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The columns that :func:`packed` took, in their order; the text as a string."""
    return df.select(*[F.col(f"`{text_col}`").cast("string").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of about ``BATCH_BYTES`` (or one row), whatever the
    length of the texts; a session that sets its own bound keeps it."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return df.mapInArrow(run, schema)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder; Hadoop deletes it when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives later steps column
    pruning and real sizes. Written at once.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def semi_join(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in the one-column table ``keys``.

    Few keys (counted) are broadcast, so ``df`` is not shuffled; more of them
    go through a shuffled join. The result is the same.
    """
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, column, "left_semi")
