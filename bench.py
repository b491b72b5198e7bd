"""Benchmark the headline queries.

Runs each query over the tables in ``$BENCH_SF_DIR`` (default
``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]`` and prints one JSON line.
Every query is executed in full with the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.operators.embed import embed_column  # noqa: E402
from tessera.operators.kmeans import kmeans_fit_predict  # noqa: E402
from tessera.plans.queries import QUERIES  # noqa: E402
from tessera.session import get_session  # noqa: E402

HEADLINE = [
    "lang_distribution",  # flagship: join + group-by + window on small rows
    "ner_route_counts",  # stage 1 over every document
    "embed_text_norm",  # full-text embedding of every document
    "semantic_entropy",  # paragraph entropy of every document
    "cluster_quality",  # stage 3: kNN, median mask, entropy, top-k
    "top_clusters",  # stage 3 ranking per language
    "cluster_assembly",  # stage 2 assembly with exact member positions
    "kmeans_single_lang",  # stage 2: per-language MLlib KMeans
    "multi_lang_dominated",  # stage 4: standardise, KMeans, dominance
    "dominant_lang_clusters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(
        f"local[{cpus}]",
        app_name="tessera-bench",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus * 2)),
        extra_conf={"spark.driver.memory": "16g"},
    )
    # warm-up, not timed: JVM code paths and one Python worker per core
    QUERIES["corpus_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["embed_prompt"](spark, sf_dir).withColumn(
        "w", embed_column("prompt")
    ).write.format("noop").mode("overwrite").save()
    # ... and MLlib's KMeans code paths (a small fit on the given vectors)
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS idx", "CAST(embedding AS array<double>) AS vec")
    kmeans_fit_predict(vecs, "vec", 8, max_iter=5)[0].write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
