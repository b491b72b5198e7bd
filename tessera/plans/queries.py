"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (``documents``, ``embeddings``) whole.
Computed columns carry the same names as their SQL oracles
(``plans.oracle``); floats are rounded to 6 places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_paragraph, paragraphs
from ..functions.vectors import cosine_distance, l2_normalize
from ..operators.crosslang import (
    clean_articles,
    cluster_sizes,
    dominant_lang_clusters,
    dominant_lang_counts,
    lang_distribution,
    lang_distribution_map,
)
from ..operators.embed import embed_texts, sparse_entries
from ..operators.entities import entity_string, ner_records, valid_labels_table
from ..operators.entropy import semantic_entropy_column
from ..operators.kmeans import assemble_clusters, assign_nearest, centroids, kmeans_fit_predict
from ..operators.ranking import group_positions
from ..operators.report import lang_share, pca_2d, sample_per_lang, source_comparison
from ..operators.scaling import standardize, zscore_outliers
from ..sources.corpus import (
    corpus_cap,
    corpus_counts,
    corpus_slice,
    load_corpus,
    merge_order_key,
    read_table,
    slice_counts,
)
from ..sources.files import parse_jsonl
from .multi_lang import cluster_records, pool_articles, run_multi_lang
from .quality_selection import score_clusters
from .single_lang import (
    articles_from_records,
    k_per_language,
    out_of_range,
    run_single_lang,
    selected_articles,
)

Query = Callable[[SparkSession, str], DataFrame]
EMB_DIM = 64


def r6(c):
    return F.round(c, 6)


# --- shared inputs derived from the given tables ----------------------------


def _corpus(spark, sf):
    return load_corpus(spark, sf)


def _ner(spark, sf):
    return ner_records(_corpus(spark, sf))


def _selected_articles(spark, sf):
    """Selected articles within one plan (first paragraph carried, no self-join)."""
    return articles_from_records(ner_records(_corpus(spark, sf), keep_first_paragraph=True))


def _vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vec")
    )


def _given_members(spark, sf):
    """Articles with a given vector; ``label`` serves as the cluster id."""
    v = _vectors(spark, sf).select(F.col("vec_id").alias("idx"), F.col("label").alias("cluster_id"), "vec")
    return _corpus(spark, sf).select("lang", "idx", "title").join(v, "idx")


def _quality(spark, sf):
    return score_clusters(_given_members(spark, sf), _corpus(spark, sf), vec_col="vec")


def _first_char_pool(spark, sf):
    """Cleaned articles with the first character of the text as a given cluster id."""
    return clean_articles(_corpus(spark, sf)).withColumn("cluster_id", F.substring("text", 1, 1))


# --- sources ------------------------------------------------------------------


def q_corpus_scan(spark, sf):
    return _corpus(spark, sf)


def q_corpus_counts(spark, sf):
    return corpus_counts(load_corpus(spark, sf, spread=False))


def q_corpus_slice(spark, sf):
    """Rows of the range [100, 300)."""
    return corpus_slice(load_corpus(spark, sf, spread=False), 100, 300).select("lang", "idx", "title")


def q_slice_counts(spark, sf):
    return slice_counts(load_corpus(spark, sf, spread=False), chunk_rows=100)


def q_corpus_cap(spark, sf):
    """The first 50 rows of every language, by position in the language."""
    return corpus_cap(load_corpus(spark, sf, spread=False), 50).select("lang", "idx", "title")


def q_chunk_merge_order(spark, sf):
    """Chunk files of ten rows, so that the name order differs from the row order."""
    c = load_corpus(spark, sf, spread=False).select("lang", "idx", merge_order_key("idx", chunk_rows=10).alias("chunk_file"))
    return group_positions(c, ["lang"], ["chunk_file", "idx"], pos_col="merge_pos", size_col=None)


def q_jsonl_read(spark, sf):
    """Tolerant read of one JSON line per document; the lines of French documents
    are cut short, those of Spanish ones have text where a number belongs."""
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    line = F.to_json(F.struct("doc_id", "lang", "source"))
    broken = F.when(F.col("lang") == "fr", F.substring(line, F.lit(1), F.length(line) - 1)).when(
        F.col("lang") == "es", F.to_json(F.struct(F.lit("many").alias("doc_id"), "lang", "source"))
    ).otherwise(line)
    good, rejected = parse_jsonl(docs.select(broken.alias("value")), T.StructType.fromDDL("doc_id bigint, lang string, source string"))
    kept = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("id_sum")).withColumn("reason", F.lit("good"))
    lost = rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("-").alias("lang"), F.lit("-").alias("source"), "n", F.lit(-1).cast("bigint").alias("id_sum"), "reason")
    return kept.unionByName(lost)


# --- projections / predicates ------------------------------------------------


def q_first_paragraph(spark, sf):
    return _corpus(spark, sf).select("lang", "idx", first_paragraph("text").alias("first_paragraph"))


def q_title_valid(spark, sf):
    from ..functions.text import title_is_valid

    return _corpus(spark, sf).select("lang", "idx", "title", title_is_valid("title").alias("title_valid"))


def q_valid_labels(spark, sf):
    langs = _corpus(spark, sf).select("lang").distinct()
    return langs.join(F.broadcast(valid_labels_table(spark)), "lang")


def q_annotate_entities(spark, sf):
    return _ner(spark, sf).select(
        "lang_code", "index", F.posexplode("entities").alias("ent_pos", "e")
    ).select(
        "lang_code",
        "index",
        F.col("ent_pos").cast("bigint").alias("ent_pos"),
        F.col("e.text").alias("ent_text"),
        F.col("e.label").alias("ent_label"),
    )


def q_entity_title_overlap(spark, sf):
    return _ner(spark, sf).select("lang_code", "index", "title", "title_valid", "has_overlap")


def _route(spark, sf, flag: bool):
    recs = _ner(spark, sf).where(F.col("selected") == flag)
    return recs.select("lang_code", "index", "title", entity_string("entities").alias("entities"))


def q_ner_selected(spark, sf):
    return _route(spark, sf, True)


def q_ner_filtered(spark, sf):
    return _route(spark, sf, False)


def q_ner_route_counts(spark, sf):
    return _ner(spark, sf).groupBy("lang_code", "selected").agg(F.count(F.lit(1)).alias("n"))


def q_selected_articles(spark, sf):
    """J1 as a lookup: selected indices joined to the corpus by ``(lang, idx)``."""
    return selected_articles(_ner(spark, sf).where("selected"), _corpus(spark, sf))


def q_selected_articles_pos(spark, sf):
    """J1 with the order of the selection, in which German articles come twice."""
    sel = _ner(spark, sf).where("selected").select("lang_code", "index")
    twice = sel.withColumn("turn", F.lit(0)).unionByName(sel.where(F.col("lang_code") == "de").withColumn("turn", F.lit(1)))
    placed = group_positions(twice, ["lang_code"], ["turn", "index"], pos_col="pos", size_col=None)
    return selected_articles(placed, _corpus(spark, sf)).select("lang", "idx", "pos", "title")


def q_bucketed_lookups(spark, sf):
    """J1, J2 and J3 over a corpus that is written once by their key and not moved by any of them."""
    from ..sources.corpus import bucket_corpus
    from .quality_selection import cluster_members

    corpus = bucket_corpus(_corpus(spark, sf))
    selected = selected_articles(_ner(spark, sf).where("selected"), corpus).select(F.lit("selected").alias("lookup"), "lang", "idx", "title")
    members = cluster_members(_given_members(spark, sf), corpus).select(F.lit("members").alias("lookup"), "lang", "idx", "title")
    pooled = pool_articles(_given_members(spark, sf).where("cluster_id < 3"), corpus).select(F.lit("pooled").alias("lookup"), F.col("lang_code").alias("lang"), "idx", "title")
    return selected.unionByName(members).unionByName(pooled)


def q_embed_prompt(spark, sf):
    from ..functions.text import embed_prompt

    return _selected_articles(spark, sf).select(
        "lang", "idx", embed_prompt("title", "first_paragraph").alias("prompt")
    )


def q_index_out_of_range(spark, sf):
    """A selection that reaches past the end: three times each given id."""
    sel = _vectors(spark, sf).select((F.col("vec_id") * 3).alias("idx"))
    return out_of_range(sel, load_corpus(spark, sf, spread=False), keys=("idx",))


def q_paragraphs(spark, sf):
    return _corpus(spark, sf).select("lang", "idx", F.posexplode(paragraphs("text")).alias("p", "paragraph")).withColumn(
        "p", F.col("p").cast("bigint")
    )


def q_clean_articles(spark, sf):
    return clean_articles(_corpus(spark, sf))


# --- embeddings -----------------------------------------------------------------


def q_embed_hash(spark, sf):
    from ..functions.text import embed_prompt

    arts = _selected_articles(spark, sf).withColumn("prompt", embed_prompt("title", "first_paragraph"))
    vecs = embed_texts(arts, "prompt", "vec")
    return sparse_entries(vecs, ["lang", "idx"], "vec")


def q_embed_text_norm(spark, sf):
    vecs = embed_texts(_corpus(spark, sf), "text", "vec", normalize=True)
    return sparse_entries(vecs, ["lang", "idx"], "vec").withColumn("weight", r6(F.col("weight")))


def q_embed_paragraphs(spark, sf):
    paras = _corpus(spark, sf).select("lang", "idx", paragraphs("text").alias("ps")).where(F.size("ps") > 1)
    long = paras.select("lang", "idx", F.posexplode("ps").alias("p", "paragraph")).withColumn(
        "p", F.col("p").cast("bigint")
    )
    vecs = embed_texts(long, "paragraph", "vec", normalize=True)
    return sparse_entries(vecs, ["lang", "idx", "p"], "vec").withColumn("weight", r6(F.col("weight")))


def q_semantic_entropy(spark, sf):
    return _corpus(spark, sf).select(
        "lang", "idx", r6(semantic_entropy_column("text")).alias("semantic_entropy")
    )


# --- joins / vectors ---------------------------------------------------------------


def q_cluster_members(spark, sf):
    from .quality_selection import cluster_members

    return cluster_members(_given_members(spark, sf), _corpus(spark, sf)).select("lang", "cluster_id", "idx", "title")


def q_knn_avg_distance(spark, sf):
    q = _quality(spark, sf)
    return q.members.select("lang", "cluster_id", "idx", r6(F.col("avg_distance")).alias("avg_distance"), "group_size")


def q_knn_neighbours(spark, sf):
    """J4 without pair rows: the 5 nearest members of every member."""
    from ..operators.knn import knn_neighbours
    from .quality_selection import GROUP, cluster_members

    from ..session import cut_lineage

    # members feed the size aggregate and both sides of the block join: materialise once
    m = cut_lineage(cluster_members(_given_members(spark, sf), _corpus(spark, sf)).select(*GROUP, "idx", "vec"))
    nn = knn_neighbours(m, GROUP, "idx", "vec")
    return nn.select("lang", "cluster_id", "idx", "nn_rank", "nn_id", r6(F.col("distance")).alias("distance"))


def q_paragraph_similarity(spark, sf):
    """J5 without pair rows: each paragraph's similarity row sum."""
    from ..operators.entropy import paragraph_row_sums_column

    c = _corpus(spark, sf).select("lang", "idx", paragraph_row_sums_column("text").alias("sums"))
    return c.select("lang", "idx", F.posexplode("sums").alias("p", "sim_rowsum")).select(
        "lang", "idx", F.col("p").cast("bigint").alias("p"), r6(F.col("sim_rowsum")).alias("sim_rowsum")
    )


def q_knn_density(spark, sf):
    q = _quality(spark, sf)
    return q.members.select("lang", "cluster_id", "idx", r6(F.col("density")).alias("density"))


def q_density_mask(spark, sf):
    q = _quality(spark, sf)
    return q.members.select(
        "lang", "cluster_id", "idx", r6(F.col("median_distance")).alias("median_distance"), "kept"
    )


def q_top_texts(spark, sf):
    q = _quality(spark, sf)
    return q.top.select(
        "lang",
        "cluster_id",
        "idx",
        "title",
        F.col("rank").cast("bigint").alias("rank"),
        r6(F.col("semantic_entropy")).alias("semantic_entropy"),
        r6(F.col("density")).alias("density"),
    )


def q_top_density_texts(spark, sf):
    """Nested top texts per cluster (bounded: at most 10), titles in rank order."""
    from .quality_selection import top_density_texts

    nested = top_density_texts(_quality(spark, sf).top)
    return nested.select(
        "lang",
        "cluster_id",
        F.size("top_density_texts").cast("bigint").alias("n_top"),
        F.array_join(F.transform("top_density_texts", lambda t: t["title"]), "|").alias("top_titles"),
    )


def q_cluster_quality(spark, sf):
    q = _quality(spark, sf)
    return q.clusters.select(
        "lang", "cluster_id", "cluster_size", "n_top", r6(F.col("avg_semantic_entropy")).alias("avg_semantic_entropy")
    )


def q_cluster_quality_gaps(spark, sf):
    """Cluster scores where some clusters are empty and some have members without an article."""
    given = _given_members(spark, sf)
    past = given.select("lang", (F.col("idx") + 1_000_000_000).alias("idx"), (F.col("cluster_id") + 1000).alias("cluster_id"), "title", "vec")
    members = given.unionByName(past)
    sizes = members.groupBy("lang", "cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    empty = given.select("lang", (F.col("cluster_id") + 2000).alias("cluster_id")).distinct().withColumn("cluster_size", F.lit(0).cast("bigint"))
    q = score_clusters(members, _corpus(spark, sf), vec_col="vec", clusters=sizes.unionByName(empty))
    return q.clusters.select(
        "lang", "cluster_id", "cluster_size", "n_top", r6(F.coalesce("avg_semantic_entropy", F.lit(-1.0))).alias("avg_semantic_entropy"), "cluster_rank"
    )


def q_knn_blocked(spark, sf):
    """V3 with three-row blocks: every group is a join of block pairs."""
    from ..operators.knn import knn_mean_distance

    v = _vectors(spark, sf).select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("idx"), "vec")
    out = knn_mean_distance(v, ["cluster_id"], "idx", "vec", block_rows=3)
    return out.select("cluster_id", "idx", r6(F.col("avg_distance")).alias("avg_distance"), "group_size")


def _clusters_route(spark, sf, flag: bool):
    q = _quality(spark, sf)
    return q.clusters.where(F.col("is_top") == flag).select(
        "lang", "cluster_id", "cluster_rank", "n_clusters", r6(F.col("avg_semantic_entropy")).alias("avg_semantic_entropy")
    )


def q_top_clusters(spark, sf):
    return _clusters_route(spark, sf, True)


def q_rest_clusters(spark, sf):
    return _clusters_route(spark, sf, False)


def q_pool_articles(spark, sf):
    q = _quality(spark, sf)
    top_members = _given_members(spark, sf).join(
        q.clusters.where("is_top").select("lang", "cluster_id", "cluster_rank"), ["lang", "cluster_id"]
    )
    return pool_articles(
        top_members.select("lang", "idx", "cluster_rank"), _corpus(spark, sf), with_sel_pos=True, order_cols=["cluster_rank"]
    )


def q_l2_normalize(spark, sf):
    v = _vectors(spark, sf).withColumn("n", l2_normalize("vec"))
    return v.select("vec_id", F.posexplode("n").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), r6(F.col("value")).alias("value")
    )


def q_cosine_distance(spark, sf):
    v = _vectors(spark, sf)
    cents = centroids(v, "label", "vec", EMB_DIM).select("label", "centroid")
    j = v.join(cents, "label")
    return j.select("vec_id", "label", r6(cosine_distance("vec", "centroid")).alias("distance"))


def q_standardize(spark, sf):
    s = standardize(_vectors(spark, sf), "vec", EMB_DIM, "z")
    return s.select("vec_id", F.posexplode("z").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), r6(F.col("value")).alias("value")
    )


def q_zscore_outliers(spark, sf):
    z = zscore_outliers(_vectors(spark, sf), "vec", EMB_DIM)
    return z.select("vec_id", r6(F.col("max_abs_z")).alias("max_abs_z"), "kept")


# --- clustering ----------------------------------------------------------------------


def q_cluster_count_rule(spark, sf):
    return k_per_language(_selected_articles(spark, sf))


def _fixed_label_articles(spark, sf):
    from ..session import cut_lineage

    # stage-1 output used three times below: materialise it once
    arts = cut_lineage(
        _selected_articles(spark, sf).join(_vectors(spark, sf).select(F.col("vec_id").alias("idx"), "label"), "idx")
    )
    ks = k_per_language(arts)
    lab = arts.join(ks.select("lang", "k"), "lang").withColumn(
        "cluster_id", F.pmod(F.col("label"), F.col("k")).cast("int")
    )
    return lab, ks


def q_cluster_assembly(spark, sf):
    lab, ks = _fixed_label_articles(spark, sf)
    out = assemble_clusters(lab.select("lang", "cluster_id", "idx", "title"), ks)
    # empty clusters: -1 instead of null keeps the integer columns integral
    return out.select(
        "lang",
        "cluster_id",
        "cluster_size",
        F.coalesce("member_pos", F.lit(-1).cast("bigint")).alias("member_pos"),
        F.coalesce("idx", F.lit(-1).cast("bigint")).alias("idx"),
        "title",
    )


def _fixed_assignment(spark, sf):
    v = _vectors(spark, sf)
    return assign_nearest(v, "vec", centroids(v, "label", "vec", EMB_DIM), centre_col="label")


def q_kmeans_assign_fixed(spark, sf):
    a = _fixed_assignment(spark, sf)
    return a.select("vec_id", "cluster_id", r6(F.col("centre_distance")).alias("centre_distance"))


def q_kmeans_lloyd_step(spark, sf):
    a = _fixed_assignment(spark, sf)
    c = centroids(a, "cluster_id", "vec", EMB_DIM)
    return c.select("cluster_id", F.posexplode("centroid").alias("dim", "value")).select(
        "cluster_id", F.col("dim").cast("bigint").alias("dim"), r6(F.col("value")).alias("value")
    )


def q_kmeans_single_lang(spark, sf):
    labelled, _ = run_single_lang(_selected_articles(spark, sf))
    return labelled.select("lang", "idx", "cluster_id")


def q_single_lang_clusters(spark, sf):
    _, clusters = run_single_lang(_selected_articles(spark, sf))
    return clusters.select("lang", "cluster_id", "cluster_size", "member_pos", "idx", "title")


def q_kmeans_multi_lang(spark, sf):
    samples, _, _ = run_multi_lang(clean_articles(_corpus(spark, sf)))
    return samples.select("lang_code", "idx", "cluster_id")


def q_multi_lang_dominated(spark, sf):
    _, _, dominated = run_multi_lang(clean_articles(_corpus(spark, sf)))
    return dominated


def _off_centre(labelled, fit, vec_col: str, label_col: str):
    """Rows with a centre nearer than their own (beyond rounding), counted in SQL-free plain NumPy."""
    import numpy as np

    from ..operators.kmeans import nearest

    @F.pandas_udf("long")
    def off(vec: pd.Series, label: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype="int64")
        x, centres = np.stack(vec.to_numpy()), fit.here()
        own = ((x - centres[label.to_numpy()]) ** 2).sum(axis=1)
        return pd.Series((own > nearest(x, centres)[1] + 1e-9).astype("int64"))

    return labelled.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col(label_col) >= 0) & (F.col(label_col) < fit.k)).alias("n_in_range"),
        F.sum(off(vec_col, label_col)).alias("n_off_centre"),
    ).withColumn("k", F.lit(fit.k).cast("bigint"))


def _tenth(v):
    """The k rule on the distinct given vectors."""
    return max(2, v.select("vec").distinct().count() // 10)


def q_kmeans_invariants(spark, sf):
    """KMeans of the given vectors, k = n // 10 distinct: every row is labelled and at its nearest centre."""
    v = _vectors(spark, sf)
    labelled, fit = kmeans_fit_predict(v.select("vec_id", "vec"), "vec", _tenth(v))
    return _off_centre(labelled, fit, "vec", "cluster_id")


def q_kmeans_seeding(spark, sf):
    """Seeding of the given vectors: exactly k different centres, and after all iterations no more cost than from random ones."""
    v = _vectors(spark, sf).select("vec_id", "vec")
    k = _tenth(v)
    _, seeds = kmeans_fit_predict(v, "vec", k, max_iter=0)
    _, seeded = kmeans_fit_predict(v, "vec", k)
    _, random = kmeans_fit_predict(v, "vec", k, init="random")
    different = seeds.table(spark).select("centroid").distinct().count()
    return spark.createDataFrame([(k, different, seeded.cost <= random.cost)], "k long, n_different long, no_worse_than_random boolean")


def q_kmeans_bounds(spark, sf):
    """Iterations with carried bounds on the given vectors against plain ones from the same seeds: rows with
    another label, and whether more than half of the evaluations were skipped after the third round."""
    import numpy as np

    from ..operators.kmeans import nearest
    from ..session import cut_lineage
    from ..sources.corpus import ensure_parallelism

    # written once by many tasks: every round reads it again
    v = cut_lineage(ensure_parallelism(_vectors(spark, sf).select("vec_id", "vec")))
    k = _tenth(v)
    labelled, fit = kmeans_fit_predict(v, "vec", k)
    _, seeds = kmeans_fit_predict(v, "vec", k, max_iter=0)
    plain = seeds
    for _ in range(fit.iterations):  # plain Lloyd: every row against every centre, means by aggregation
        before, plain = plain, plain.replaced(centroids(_assigned(v, plain), "cluster_id", "vec", EMB_DIM))
        before.pieces.destroy()

    @F.pandas_udf("long")
    def other(vec: pd.Series, label: pd.Series) -> pd.Series:
        return pd.Series((nearest(np.stack(vec.to_numpy()), plain.here())[0] != label.to_numpy()).astype("int64") if len(vec) else [], dtype="int64")

    late = fit.skipped[3:]
    return labelled.agg(F.count(F.lit(1)).alias("n"), F.sum(other("vec", "cluster_id")).alias("n_other_label")).withColumn("skips_half", F.lit(not late or sum(late) / len(late) > 0.5))


def _assigned(v, fit):
    """Every row with its nearest centre."""
    import numpy as np

    from ..operators.kmeans import nearest

    @F.pandas_udf("int")
    def near(vec: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.stack(vec.to_numpy()), fit.here())[0] if len(vec) else [], dtype="int32")

    return v.withColumn("cluster_id", near("vec"))


def q_kmeans_tree_cost(spark, sf):
    """The tree on the given vectors, with cells small enough to be split: all ids in use, every row
    labelled once, and its cost is at most 1.25 times that of the flat fit."""
    from ..operators.kmeans import two_level_kmeans
    from ..session import cut_lineage

    v = _vectors(spark, sf).select("vec_id", "vec")
    k = _tenth(v)
    _, flat = kmeans_fit_predict(v, "vec", k)
    tree = cut_lineage(two_level_kmeans(v, "vec", k, max_cell=100))
    at = F.col("centroid")
    spread = F.aggregate(F.zip_with("vec", at, lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda acc, d: acc + d)
    rows = tree.join(centroids(tree, "cluster_id", "vec", EMB_DIM).select("cluster_id", "centroid"), "cluster_id")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_once"), F.countDistinct("cluster_id").alias("k"), (F.sum(spread) <= 1.25 * flat.cost).alias("near_flat")
    )


def q_kmeans_single_lang_invariants(spark, sf):
    """Per language: rows in, rows labelled once, labels inside range(k), sizes that sum to n."""
    labelled, clusters = run_single_lang(_selected_articles(spark, sf))
    n = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("n_once"), F.min("cluster_id").cast("bigint").alias("least"), F.max("cluster_id").alias("last"))
    sizes = clusters.select("lang", "cluster_id", "cluster_size").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("k"), F.sum("cluster_size").alias("size_sum"))
    return n.join(sizes, "lang").select("lang", "n", "n_once", "k", "size_sum", ((F.col("least") >= 0) & (F.col("last") < F.col("k"))).alias("in_range"))


def q_kmeans_two_level_invariants(spark, sf):
    """The same for the two-level method, with cells small enough to be split again."""
    labelled, clusters = run_single_lang(_selected_articles(spark, sf), method="two_level", max_cell=60)
    n = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("n_once"), F.min("cluster_id").cast("bigint").alias("least"), F.max("cluster_id").alias("last"))
    sizes = clusters.select("lang", "cluster_id", "cluster_size").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("k"), F.sum("cluster_size").alias("size_sum"))
    return n.join(sizes, "lang").select("lang", "n", "n_once", "k", "size_sum", ((F.col("least") >= 0) & (F.col("last") < F.col("k"))).alias("in_range"))


def q_kmeans_multi_lang_invariants(spark, sf):
    """Stage-4 KMeans: every cleaned article labelled once, labels inside range(1000)."""
    samples, _, _ = run_multi_lang(clean_articles(_corpus(spark, sf)))
    return samples.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("lang_code", "idx").alias("n_once"), ((F.min("cluster_id") >= 0) & (F.max("cluster_id") < 1000)).alias("in_range")
    )


def q_pca_invariants(spark, sf):
    """Components of the given vectors: centred, uncorrelated, ordered by variance."""
    p = pca_2d(_vectors(spark, sf), "vec", EMB_DIM)
    return p.agg(
        F.count(F.lit(1)).alias("n"),
        (F.abs(F.avg("pc1")) + F.abs(F.avg("pc2")) < 1e-6).alias("centred"),
        (F.abs(F.covar_pop("pc1", "pc2")) < 1e-6).alias("uncorrelated"),
        (F.var_pop("pc1") >= F.var_pop("pc2")).alias("ordered"),
    )


def q_culture_clusters(spark, sf):
    """All four stages end to end on the whole corpus (KMeans labels: rows-only check)."""
    from .end_to_end import run_all_stages

    return run_all_stages(_corpus(spark, sf)).dominated


# --- interchange formats -----------------------------------------------------------------------


def q_json_arrays(spark, sf):
    """S8, S9: the corpus written as one JSON array per language by many tasks, read back by byte ranges."""
    from ..session import ensure_checkpoint_dir
    from ..sources.files import read_json_array_split, write_json_arrays

    corpus = load_corpus(spark, sf)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/arrays-{uuid.uuid4().hex}"
    write_json_arrays(corpus.select(F.col("lang").alias("file"), "lang", "idx", "title", "text"), folder, "file", ["idx"])
    back = read_json_array_split(spark, folder, T.StructType.fromDDL("lang string, idx long, title string, text string"))
    return back.select("lang", "idx", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_curated_points(spark, sf):
    """S10: the clusters of the given labels written as the curated object ``{lang: [cluster, ...]}``, read back to member rows."""
    from ..session import ensure_checkpoint_dir
    from ..sources.files import curated_member_rows, read_curated_points

    members = _label_samples(spark, sf).join(load_corpus(spark, sf, spread=False).select("lang", "idx", "title"), "idx").where("lang = lang_code").select("lang", F.col("cluster_id").cast("int").alias("cluster_id"), "title", "idx")
    # a curated file is small by nature: a few clusters chosen by hand (here the first 20 members of each)
    w = Window.partitionBy("lang", "cluster_id").orderBy("idx")
    first = members.withColumn("rank", F.row_number().over(w)).where("rank <= 20").groupBy("lang", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("idx", "title"))).alias("m"))
    cluster = F.struct("cluster_id", F.size("m").alias("cluster_size"), F.lit("theme").alias("theme"), F.lit("described").alias("description"), F.col("m.title").alias("titles"), F.col("m.idx").alias("indices"))
    langs = first.groupBy("lang").agg(F.collect_list(cluster).alias("clusters"))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/curated-{uuid.uuid4().hex}"
    langs.agg(F.map_from_entries(F.collect_list(F.struct("lang", "clusters"))).alias("m")).select(F.to_json("m")).coalesce(1).write.text(folder)
    return curated_member_rows(read_curated_points(spark, folder)).select("lang", F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("member_pos").cast("bigint").alias("member_pos"), "title", "idx")


# --- aggregations -----------------------------------------------------------------------


def _label_samples(spark, sf):
    return _corpus(spark, sf).select(F.col("lang").alias("lang_code"), "idx").join(
        _vectors(spark, sf).select(F.col("vec_id").alias("idx"), F.col("label").alias("cluster_id")), "idx"
    )


def q_cluster_sizes(spark, sf):
    return cluster_sizes(_label_samples(spark, sf))


def q_lang_distribution(spark, sf):
    return lang_distribution(_label_samples(spark, sf))


def q_lang_distribution_map(spark, sf):
    """A2 as a map per cluster, rendered ``lang:count`` in language order."""
    m = lang_distribution_map(lang_distribution(_label_samples(spark, sf)))
    entries = F.transform(F.array_sort(F.map_entries("lang_distribution")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return m.select("cluster_id", "sample_count", F.array_join(entries, ",").alias("lang_distribution"))


def q_stage4_records(spark, sf):
    """Stage-4 records of given cluster ids: language map and nested samples with
    their selection position, for clusters of at most 60 samples."""
    pool = group_positions(load_corpus(spark, sf), ["lang"], ["idx"], pos_col="sel_pos", size_col=None)
    samples = clean_articles(pool, keep=["sel_pos"]).withColumn("cluster_id", F.substring("text", 1, 1))
    rec = cluster_records(samples, lang_distribution(samples), 60)
    entries = F.transform(F.array_sort(F.map_entries("lang_distribution")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    members = F.transform("samples", lambda s: F.concat(s["lang_code"], F.lit("/"), s["index"].cast("string"), F.lit("/"), s["title"]))
    return rec.select("cluster_id", "sample_count", F.array_join(entries, ",").alias("lang_distribution"), F.coalesce(F.array_join(members, "|"), F.lit("-")).alias("samples"))


def q_cluster_min_size(spark, sf):
    d = lang_distribution(_first_char_pool(spark, sf))
    return d.select("cluster_id", "sample_count").distinct()


def _dominated(spark, sf):
    return dominant_lang_clusters(lang_distribution(_first_char_pool(spark, sf)))


def q_dominant_lang_clusters(spark, sf):
    return _dominated(spark, sf).withColumn("ratio", r6(F.col("ratio")))


def q_dominant_lang_counts(spark, sf):
    return dominant_lang_counts(_dominated(spark, sf))


# --- reports ---------------------------------------------------------------------------------


def q_sample_per_lang(spark, sf):
    s = sample_per_lang(_corpus(spark, sf), 50)
    return s.select("lang", "idx", F.col("sample_rank").cast("bigint").alias("sample_rank"))


def q_pca_2d(spark, sf):
    p = pca_2d(_vectors(spark, sf), "vec", EMB_DIM)
    return p.select("vec_id", r6(F.col("pc1")).alias("pc1"), r6(F.col("pc2")).alias("pc2"))


def q_lang_share(spark, sf):
    return lang_share(load_corpus(spark, sf, spread=False)).withColumn("share", r6(F.col("share")))


def q_source_centroids(spark, sf):
    """R4, centroid side: raw vs selected mean text embedding per language."""
    from ..operators.entities import selection_flag
    from ..operators.report import source_centroid_shift

    flagged = selection_flag(_corpus(spark, sf))
    vecs = embed_texts(flagged.select("lang", "idx", "text", "selected"), "text", "vec", normalize=True)
    out = source_centroid_shift(vecs, "vec", "selected", EMB_DIM)
    return out.withColumn("centroid_distance", r6(F.col("centroid_distance")))


def q_source_comparison(spark, sf):
    """R4, share side: raw vs selected language shares in one pass over the corpus."""
    from ..operators.entities import selection_flag
    from ..operators.report import flagged_source_comparison

    out = flagged_source_comparison(selection_flag(_corpus(spark, sf)).select("lang", "selected"), "selected")
    return out.withColumn("raw_share", r6(F.col("raw_share"))).withColumn("selected_share", r6(F.col("selected_share")))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

FLAGSHIP = "lang_distribution"
