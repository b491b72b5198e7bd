import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tessera.operators.entities import ner_records
from tessera.sources.corpus import load_corpus
from tessera.streaming.ner_stream import (
    read_documents_stream,
    selection_stream,
    start_route_counts,
    start_selection_sink,
)


def test_streaming_selection_equals_batch(spark):
    out = tempfile.mkdtemp(prefix="tessera-stream-")
    ck = tempfile.mkdtemp(prefix="tessera-stream-ck-")
    recs = selection_stream(read_documents_stream(spark, f"{SF_SMALL}/documents*.parquet"))
    q = start_selection_sink(recs, os.path.join(out, "routes"), checkpoint_location=os.path.join(ck, "sel"))
    q.awaitTermination(180)
    streamed = spark.read.parquet(os.path.join(out, "routes")).withColumn("selected", F.col("selected").cast("boolean"))
    batch = ner_records(load_corpus(spark, SF_SMALL))
    got = sorted((r["lang_code"], r["index"], r["selected"]) for r in streamed.collect())
    exp = sorted((r["lang_code"], r["index"], r["selected"]) for r in batch.collect())
    assert got == exp

    q2 = start_route_counts(recs, name="route_counts_test", checkpoint_location=os.path.join(ck, "cnt"))
    q2.awaitTermination(180)
    counts = {(r["lang_code"], r["selected"]): r["n"] for r in spark.sql("SELECT * FROM route_counts_test").collect()}
    exp_counts = {}
    for lang, _, sel in exp:
        exp_counts[(lang, sel)] = exp_counts.get((lang, sel), 0) + 1
    assert counts == exp_counts


def test_streaming_restart_resumes_from_checkpoint(spark):
    out = tempfile.mkdtemp(prefix="tessera-stream-")
    ck = tempfile.mkdtemp(prefix="tessera-stream-ck-")
    path = os.path.join(out, "routes")
    for _ in range(2):  # second run finds nothing new in the source
        recs = selection_stream(read_documents_stream(spark, f"{SF_SMALL}/documents*.parquet"))
        q = start_selection_sink(recs, path, name="restart_test", checkpoint_location=os.path.join(ck, "sel"))
        q.awaitTermination(180)
    n_docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    got = spark.read.parquet(path)
    assert got.count() == got.select("lang_code", "index").distinct().count() <= n_docs
