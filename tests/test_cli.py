import os
import tempfile

from tests.conftest import SF_SMALL
from tessera.cli import main


def test_stage_by_stage_cli(spark):
    out = tempfile.mkdtemp(prefix="tessera-cli-")
    corpus = ["--corpus", f"{SF_SMALL}/documents.parquet", "--documents"]
    main(["ner", *corpus, "--out", f"{out}/ner"])
    main(["single-lang", *corpus, "--selected", f"{out}/ner/selected", "--out", f"{out}/clusters", "--max-iter", "10"])
    main(["quality", *corpus, "--clusters", f"{out}/clusters", "--out", f"{out}/quality"])
    main(
        ["multi-lang", *corpus, "--quality", f"{out}/quality", "--clusters", f"{out}/clusters",
         "--out", f"{out}/multi", "--k", "20", "--max-iter", "10"]
    )
    q = spark.read.parquet(f"{out}/quality")
    assert q.count() == spark.read.parquet(f"{out}/clusters").select("lang", "cluster_id").distinct().count()
    assert os.path.isdir(f"{out}/multi/samples")
    for r in spark.read.parquet(f"{out}/multi/dominated").collect():
        assert r["sample_count"] >= 5 and r["ratio"] >= 0.8
