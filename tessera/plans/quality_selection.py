"""Stage 3: score every cluster by density and semantic entropy, keep the best.

Per cluster (group ``(lang, cluster_id)``):

1. members joined to the corpus text, blank texts dropped;
2. member vectors (given, or the normalised full-text embedding);
3. mean distance to the 5 nearest members (self included) - exact, blocked;
4. keep members with ``distance <= median`` (exact median), density ``1/(d+1e-8)``;
5. semantic entropy of each kept text's paragraphs;
6. top 10 kept texts by entropy (ties in input order);
7. cluster score = mean entropy of its top texts;
8. per language, the first ``int(n * 0.2)`` clusters by score are *top*.

All languages run in one plan keyed by ``(lang, cluster_id)``. Every part is
made when it is first asked for and written once: the kNN distances do not
run entropy, and the vectors, a narrow table without texts, are all that kNN
reads. Texts are joined last, for the kept members only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import KNN_K, TOP_CLUSTER_FRACTION, TOP_TEXTS_PER_CLUSTER
from ..functions.text import is_blank
from ..operators.embed import embed_texts
from ..operators.entropy import LONG_DOCUMENT, long_document_entropy, semantic_entropy_column
from ..operators.knn import knn_mean_distance
from ..operators.quality import cluster_scores, density_mask, split_top_fraction, top_texts
from ..operators.ranking import join_groups
from ..session import cut_lineage

GROUP = ["lang", "cluster_id"]


def cluster_members(members: DataFrame, corpus: DataFrame) -> DataFrame:
    """Members with their article text; the title is the cluster's, not the corpus's."""
    text = corpus.select("lang", "idx", "text")
    return members.join(text, ["lang", "idx"]).where(~is_blank("text"))


class QualityResult:
    """Stage 3 over ``members(lang, cluster_id, idx, title[, vec_col])``, part by part."""

    def __init__(self, members, corpus, vec_col, embedder, k, top_k, fraction, clusters, order_col) -> None:
        self._given, self._corpus, self._vec_col, self._embedder = members, corpus, vec_col, embedder
        self._k, self._top_k, self._fraction, self._clusters, self._order = k, top_k, fraction, clusters, order_col

    @cached_property
    def vectors(self) -> DataFrame:
        """``lang, cluster_id, idx, title, vec[, order_col]`` of members with a non-blank text."""
        keep = dict.fromkeys([*GROUP, "idx", "title", self._order])
        if self._vec_col is None:
            out = embed_texts(cluster_members(self._given.select(*keep), self._corpus), "text", "vec", self._embedder, normalize=True)
            return cut_lineage(out.select(*keep, "vec"))
        # only the keys of the corpus travel; its texts are tested in the scan
        there = self._corpus.where(~is_blank("text")).select("lang", "idx")
        return cut_lineage(self._given.select(*keep, F.col(self._vec_col).alias("vec")).join(there, ["lang", "idx"]).select(*keep, "vec"))

    @cached_property
    def distances(self) -> DataFrame:
        """``lang, cluster_id, idx, avg_distance, group_size``."""
        return cut_lineage(knn_mean_distance(self.vectors.select(*GROUP, "idx", "vec"), GROUP, "idx", "vec", k=self._k))

    @cached_property
    def members(self) -> DataFrame:
        """Distances, median, ``kept`` flag and density, with title and input order."""
        return join_groups(density_mask(self.distances, GROUP, "idx"), self.vectors.drop("vec"), [*GROUP, "idx"])

    @cached_property
    def candidates(self) -> DataFrame:
        """Kept members with the entropy of their text; inference runs once, here."""
        kept = cut_lineage(self.members.where("kept"))
        texts = kept.join(self._corpus.select("lang", "idx", "text"), ["lang", "idx"])
        scored = cut_lineage(texts.withColumn("semantic_entropy", semantic_entropy_column("text", self._embedder, LONG_DOCUMENT)).drop("text"))
        # documents too long for one task, if there are any
        long = scored.where(F.col("semantic_entropy").isNull())
        if not long.limit(1).count():
            return scored
        once = long.select("lang", "idx").distinct().join(self._corpus.select("lang", "idx", "text"), ["lang", "idx"])
        rest = long.drop("semantic_entropy").join(long_document_entropy(once, ["lang", "idx"], "text", self._embedder), ["lang", "idx"])
        return cut_lineage(scored.where(F.col("semantic_entropy").isNotNull()).unionByName(rest))

    @cached_property
    def top(self) -> DataFrame:
        """Top texts with rank."""
        return top_texts(self.candidates, GROUP, "semantic_entropy", [self._order], k=self._top_k)

    @cached_property
    def clusters(self) -> DataFrame:
        """``lang, cluster_id, cluster_size, avg_semantic_entropy, n_top, cluster_rank, n_clusters, is_top``."""
        every = self._clusters
        if every is None:
            every = self._given.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("cluster_size"))
        return split_top_fraction(cluster_scores(every, self.top, GROUP), "lang", "avg_semantic_entropy", "cluster_id", self._fraction)


def score_clusters(
    members: DataFrame,
    corpus: DataFrame,
    vec_col: str | None = None,
    embedder=None,
    k: int = KNN_K,
    top_k: int = TOP_TEXTS_PER_CLUSTER,
    fraction: float = TOP_CLUSTER_FRACTION,
    clusters: DataFrame | None = None,
    order_col: str = "idx",
) -> QualityResult:
    """Stage 3 on ``members(lang, cluster_id, idx, title[, vec_col])``; nothing runs yet.

    ``clusters(lang, cluster_id, cluster_size)`` may list empty clusters too;
    by default it is derived from ``members``. ``order_col`` is the members'
    input order (ties), ``cluster_id`` the clusters' input order.
    """
    return QualityResult(members, corpus, vec_col, embedder, k, top_k, fraction, clusters, order_col)


def top_density_texts(top: DataFrame) -> DataFrame:
    """Nested ``top_density_texts`` per cluster (bounded: at most ``top_k`` entries)."""
    return top.groupBy(*GROUP).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "title", "density", "semantic_entropy"))),
            lambda s: F.struct(s["title"].alias("title"), s["density"].alias("density"), s["semantic_entropy"].alias("semantic_entropy")),
        ).alias("top_density_texts")
    )
