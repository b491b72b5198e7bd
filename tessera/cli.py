"""Command line: run one stage, or all four, over tables on shared storage.

    python -m tessera ner         --corpus C --out O/ner
    python -m tessera single-lang --corpus C --selected O/ner/selected --out O/clusters
    python -m tessera quality     --corpus C --clusters O/clusters --out O/quality
    python -m tessera multi-lang  --corpus C --quality O/quality --clusters O/clusters --out O/multi
    python -m tessera all         --corpus C --out O

``--corpus`` is Parquet with ``lang, idx, title, text`` or, with
``--documents``, a ``documents(doc_id, text, lang)`` table (title derived).
Stage 1 writes JSON Lines; later stages write Parquet partitioned by language.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .constants import CROSSLANG_K, DOMINANCE_RATIO
from .plans.end_to_end import run_all_stages, write_stages
from .plans.multi_lang import cluster_records, pool_articles, run_multi_lang
from .plans.ner_selection import run_ner_selection, write_routes
from .plans.quality_selection import score_clusters, top_density_texts
from .plans.single_lang import run_single_lang, selected_articles
from .session import cut_lineage, get_session
from .sources.corpus import corpus_from_documents, corpus_scan, ensure_parallelism
from .sources.files import read_ner_records, write_jsonl


def _corpus(spark, args):
    if args.documents:
        return corpus_from_documents(ensure_parallelism(spark.read.parquet(args.corpus)))
    return corpus_scan(spark, args.corpus)


def _parquet(df, path, partition_by=None):
    write_jsonl(df, path, partition_by=partition_by, fmt="parquet")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tessera")
    ap.add_argument("stage", choices=["ner", "single-lang", "quality", "multi-lang", "all"])
    ap.add_argument("--corpus", required=True)
    ap.add_argument("--documents", action="store_true", help="corpus is a documents(doc_id, text, lang) table")
    ap.add_argument("--out", required=True)
    ap.add_argument("--selected", help="stage-1 selected records (JSON Lines)")
    ap.add_argument("--clusters", help="stage-2 long-form clusters (Parquet)")
    ap.add_argument("--quality", help="stage-3 cluster scores (Parquet)")
    ap.add_argument("--langs", help="comma-separated language list for stage 3")
    ap.add_argument("--k", type=int, default=CROSSLANG_K)
    ap.add_argument("--ratio", type=float, default=DOMINANCE_RATIO)
    ap.add_argument("--max-iter", type=int, default=300)
    ap.add_argument("--order", choices=["index", "merge"], default="index")
    ap.add_argument("--pool-from", choices=["all", "top_texts"], default="all")
    ap.add_argument("--drop-outliers", action="store_true")
    ap.add_argument("--cap", type=int, help="first rows of each language only (default: all)")
    ap.add_argument("--method", choices=["flat", "two_level"], default="flat", help="stage-2 clustering")
    ap.add_argument("--rejects", help="where unreadable stage-1 lines go (JSON Lines: line, reason)")
    args = ap.parse_args(argv)

    spark = get_session()
    corpus = _corpus(spark, args)
    langs = args.langs.split(",") if args.langs else None

    if args.stage == "all":
        write_stages(
            run_all_stages(
                corpus,
                quality_langs=langs,
                k_multi=args.k,
                ratio=args.ratio,
                max_iter=args.max_iter,
                order=args.order,
                pool_from=args.pool_from,
                drop_outliers=args.drop_outliers,
                cap=args.cap,
                method=args.method,
            ),
            args.out,
        )
    elif args.stage == "ner":
        write_routes(cut_lineage(run_ner_selection(corpus, cap=args.cap), partition_by=["selected", "lang_code"]), args.out)
    elif args.stage == "single-lang":
        arts = selected_articles(read_ner_records(spark, args.selected, args.rejects), corpus)
        _, clusters = run_single_lang(arts, max_iter=args.max_iter, order=args.order, method=args.method)
        _parquet(clusters, args.out, ["lang"])
    elif args.stage == "quality":
        clusters = spark.read.parquet(args.clusters)
        if langs:
            clusters = clusters.where(F.col("lang").isin(langs))
        members = clusters.where(F.col("idx").isNotNull()).select("lang", "cluster_id", "idx", "title", "member_pos")
        cl = clusters.select("lang", "cluster_id", "cluster_size").distinct()
        q = score_clusters(members, corpus, clusters=cl, order_col="member_pos")
        scores = q.clusters.join(top_density_texts(q.top), ["lang", "cluster_id"], "left")
        _parquet(scores, args.out, ["lang"])
        _parquet(q.top.select("lang", "cluster_id", "idx", "rank"), f"{args.out.rstrip('/')}_top_texts")
    elif args.stage == "multi-lang":
        top = spark.read.parquet(args.quality).where("is_top").select("lang", "cluster_id", "cluster_rank")
        members = spark.read.parquet(args.clusters).where(F.col("idx").isNotNull())
        top_members = members.join(top, ["lang", "cluster_id"])
        if args.pool_from == "top_texts":
            texts = spark.read.parquet(f"{args.quality.rstrip('/')}_top_texts").select("lang", "cluster_id", "idx")
            top_members = top_members.join(texts, ["lang", "cluster_id", "idx"])
        pool = pool_articles(top_members, corpus, with_sel_pos=True, order_cols=["cluster_rank", "member_pos"])
        samples, distribution, dominated = run_multi_lang(
            pool, k=args.k, ratio=args.ratio, max_iter=args.max_iter, drop_outliers=args.drop_outliers
        )
        _parquet(samples, f"{args.out}/samples", ["lang_code"])
        _parquet(cluster_records(samples, distribution, 10_000), f"{args.out}/raw")
        _parquet(dominated, f"{args.out}/dominated")
