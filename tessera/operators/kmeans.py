"""Clustering: count rule, KMeans, fixed-centroid assignment, assembly.

``fit_predict_groups`` clusters all groups (languages) at once: see ``lloyd`` for the
seeding and the iterations. It holds the ``k x d`` centres of a group in every task (the
driver holds a piece of them at a time). ``tree_kmeans`` is the explicit alternative for large ``k``: nothing of
it is held in one place that grows with the data.

Assignment to *given* centres walks tiles of centres inside one vectorised
UDF; centres beyond a byte bound are applied block by block, with the running
best written in between. Nothing is chosen by size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import KMEANS_SEED
from ..session import bound_batches, cut_lineage
from ..sources.corpus import ensure_parallelism
from .lloyd import Fit, centre_groups, distinct_points, fit_groups, lloyd_step, plus_plus, squared_tiles
from .ranking import group_positions, join_groups

MAX_BROADCAST_BYTES = 256 << 20
#: Children of a tree's node, vectors of a node that its split is fitted on (those with the
#: smallest content hashes), and rows of a node that meet its centres in one run.
FAN_OUT = 16
SPLIT_SAMPLE = 4096
RUN_ROWS = 65_536
# Cells of the distance matrix that the assignment holds at once (2 MB: a core's own cache).
TILE_CELLS = 1 << 18


def cluster_count(n: Column | int) -> Column | int:
    """``min(max(2, n // 10), n)`` - the per-language k rule."""
    if isinstance(n, int):
        return min(max(2, n // 10), n)
    return F.least(F.greatest(F.lit(2).cast("bigint"), F.floor(n / 10).cast("bigint")), n.cast("bigint"))


def fit_predict_groups(df: DataFrame, group_col: str, vec_col: str, ks: dict, seed: int = KMEANS_SEED, max_iter: int = 300, tol: float = 1e-4, prediction_col: str = "cluster_id", init: str = "k-means||") -> tuple[DataFrame, dict[object, Fit]]:
    """Label every row with its group's nearest centre; ``ks`` gives the clusters of each group.

    All groups are fitted in the same jobs. ``k`` above the number of distinct vectors
    of a group is lowered to it; a group with one cluster has label 0 and no fit. Rows
    with a null vector have a null label. Labels do not depend on the input's order
    or partitioning.
    """
    bound_batches(df.sparkSession)
    df = ensure_parallelism(df)  # few bytes, but every row meets all centres
    points = distinct_points(df, group_col, vec_col)
    sizes = {r["grp"]: r["n"] for r in points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per group
    fits = fit_groups(points, sizes, ks, seed, max_iter, tol, init)

    @F.pandas_udf("int")
    def label(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for group, vec in batches:
            out = pd.array(np.zeros(len(vec), dtype=np.int32), dtype="Int32")
            out[vec.isna().to_numpy()] = pd.NA
            for g, rows in pd.Series(np.arange(len(vec))).groupby(group.to_numpy(), dropna=False):
                fit = fits.get(None if pd.isna(g) else g)
                at = rows.to_numpy()[vec.notna().to_numpy()[rows.to_numpy()]]
                if fit is not None and len(at):
                    out[at] = nearest(np.stack(vec.to_numpy()[at]).astype(np.float64), fit.here())[0].astype(np.int32)
            yield pd.Series(out)

    return df.withColumn(prediction_col, label.asNondeterministic()(F.col(group_col), F.col(vec_col))), fits


def kmeans_fit_predict(df: DataFrame, vec_col: str, k: int, seed: int = KMEANS_SEED, max_iter: int = 300, tol: float = 1e-4, prediction_col: str = "cluster_id", init: str = "k-means||") -> tuple[DataFrame, Fit | None]:
    """:func:`fit_predict_groups` with all rows in one group; ``(labelled, fit or None)``."""
    labelled, fits = fit_predict_groups(df.withColumn("_group", F.lit(0)), "_group", vec_col, {0: k}, seed, max_iter, tol, prediction_col, init)
    return labelled.drop("_group"), fits.get(0)


def _local_fit(x: np.ndarray, weight: np.ndarray, k: int, seed: int, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """``(centres, labels)`` of a bounded number of vectors: the same seeding and iterations inside one task."""
    centres = plus_plus(x, weight, k, seed)
    group, moved = centre_groups(centres), np.zeros(k)
    label, upper, lower = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf), np.zeros((len(x), int(group.max()) + 1))
    for _ in range(max_iter):
        label, upper, lower, _n = lloyd_step(x, label, upper, lower, centres, moved, group)
        total = np.bincount(label, weights=weight, minlength=k)
        sums = np.stack([np.bincount(label, weights=weight * x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        new = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centres)
        moved = np.sqrt(((new - centres) ** 2).sum(axis=1))
        centres = new
        if moved.max() <= tol:
            break
    return centres, nearest(x, centres)[0]


def _split_centres(points: DataFrame, cells: DataFrame, seed: int, max_iter: int, tol: float) -> DataFrame:
    """``grp, path, centres``: at most ``FAN_OUT`` centres of every cell, fitted on its
    ``SPLIT_SAMPLE`` vectors with the smallest hashes; one grouped job for all cells."""
    at = Window.partitionBy("grp", "path").orderBy("key", "vec")
    sample = join_groups(points, cells.select("grp", "path", "k"), ["grp", "path"]).withColumn("_rank", F.row_number().over(at)).where(F.col("_rank") <= SPLIT_SAMPLE)
    kind = points.schema["grp"]
    schema = T.StructType([kind, T.StructField("path", T.StringType()), T.StructField("centres", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        centres, _ = _local_fit(x, pdf["weight"].to_numpy(), min(FAN_OUT, int(pdf["k"].iloc[0]), len(x)), seed, max_iter, tol)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "path": [pdf["path"].iloc[0]], "centres": [[list(c) for c in centres]]})

    return sample.groupBy("grp", "path").applyInPandas(split, schema)


def _descend(points: DataFrame, cells: DataFrame, centres: DataFrame) -> DataFrame:
    """``points`` of the given cells with the number of their nearest child appended to ``path``.

    A cell's centres lead its rows; a large cell is dealt to many runs, each with a copy
    of the centres, so no task holds more than one cell's centres and a batch of rows."""
    runs = F.greatest(F.lit(1), F.ceil(F.col("n") / RUN_ROWS).cast("int"))
    lead = join_groups(cells.select("grp", "path", "n"), centres, ["grp", "path"]).select("grp", "path", F.explode(F.sequence(F.lit(0), runs - 1)).alias("run"), F.lit(None).cast("array<double>").alias("vec"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("long").alias("key"), "centres")
    body = join_groups(points, cells.select("grp", "path", "n"), ["grp", "path"]).select("grp", "path", F.pmod("key", runs).cast("int").alias("run"), "vec", "weight", "key", F.lit(None).cast("array<array<double>>").alias("centres"))
    both = lead.unionByName(body).repartition("grp", "path", "run").sortWithinPartitions("grp", "path", "run", F.col("centres").isNull(), "key")
    schema = T.StructType([points.schema[c] for c in ("grp", "path", "vec", "weight", "key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            marks = np.flatnonzero(batch.column("centres").is_valid().to_numpy(zero_copy_only=False))
            for a, b in zip([-1, *marks.tolist()], [*marks.tolist(), batch.num_rows], strict=True):
                if a >= 0:
                    held = np.array(batch.column("centres")[a].as_py())
                if b - a > 1:
                    rows = batch.slice(a + 1, b - a - 1)
                    x = rows.column("vec").flatten().to_numpy().reshape(rows.num_rows, -1)
                    child = nearest(x, held)[0]
                    path = pa.array([f"{p}.{c:02d}" for p, c in zip(rows.column("path").to_pylist(), child.tolist(), strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([rows.column("grp"), path, rows.column("vec"), rows.column("weight"), rows.column("key")], names=["grp", "path", "vec", "weight", "key"])

    return both.select("grp", "path", "vec", "weight", "key", "centres").mapInArrow(run, schema)


def _shares(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``grp, path, n, k, first`` of ``children(grp, path, n)``: a cell's clusters are shared out among
    its children (at most ``FAN_OUT``) by their vectors, largest remainders first, at least 1 each."""
    up = F.regexp_replace("path", r"\.[0-9]+$", "")
    own = join_groups(children.withColumn("up", up), parents.select("grp", F.col("path").alias("up"), F.col("k").alias("all_k"), F.col("first").alias("base")), ["grp", "up"])
    family = Window.partitionBy("grp", "up")
    count, total = F.count(F.lit(1)).over(family), F.sum("n").over(family)
    own = own.withColumn("spare", F.greatest(F.least("all_k", total) - count, F.lit(0))).withColumn("exact", F.when(total > count, F.col("spare") * (F.col("n") - 1) / (total - count)).otherwise(0.0))
    own = own.withColumn("left", F.col("spare") - F.sum(F.floor("exact")).over(family)).withColumn("turn", F.row_number().over(family.orderBy((F.col("exact") - F.floor("exact")).desc(), "path")))
    own = own.withColumn("k", (1 + F.floor("exact") + F.when(F.col("turn") <= F.col("left"), 1).otherwise(0)).cast("long"))
    before = F.coalesce(F.sum("k").over(family.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("first", (F.col("base") + before).cast("long")).select("grp", "path", "n", "k", "first")


def tree_kmeans(df: DataFrame, group_col: str, vec_col: str, ks: DataFrame, seed: int = KMEANS_SEED, max_iter: int = 300, tol: float = 1e-4, max_cell: int = 20_000, prediction_col: str = "cluster_id", max_levels: int = 12) -> DataFrame:
    """Label every row with one of its group's ``k`` clusters (``ks(group_col, k)``) by a tree of cells.

    A cell of more than ``max_cell`` distinct vectors is split into at most ``FAN_OUT``; all
    cells of a level are split in one grouped job, and every vector carries its path. A split
    is fitted on ``SPLIT_SAMPLE`` vectors of the cell; a leaf on all of its vectors, in one
    bounded task. Clusters are shared out from a cell to its children by their numbers of
    distinct vectors. The driver sees one number a level; paths, shares and centres are tables.

    An approximation of the flat fit, chosen by the caller, never by size. With fewer than
    ``k`` distinct vectors the number of clusters is that number. ``max_levels`` splits
    that leave a cell too big are an error. Rows with a null vector have a null label.
    """
    points = cut_lineage(distinct_points(df, group_col, vec_col).select("grp", F.lit("0").alias("path"), "vec", "weight", "key"))
    sizes = points.groupBy("grp", "path").agg(F.count(F.lit(1)).alias("n"))
    roots = join_groups(sizes, ks.select(F.col(group_col).alias("grp"), F.col("k").cast("long").alias("k")), ["grp"])
    cells = cut_lineage(roots.select("grp", "path", "n", F.greatest(F.lit(1), F.least("k", "n")).alias("k"), F.lit(0).cast("long").alias("first")))
    leaves = []
    for level in range(max_levels + 1):
        big = (F.col("n") > max_cell) & (F.col("k") > 1)
        leaves.append((points, cells.where(~big)))
        wide = cells.where(big)
        if not wide.limit(1).count():
            break
        if level == max_levels:
            raise ValueError(f"a cell keeps more than {max_cell} vectors after {max_levels} splits")
        centres = cut_lineage(_split_centres(points, wide, seed, max_iter, tol))
        points = cut_lineage(_descend(points, wide, centres))
        cells = cut_lineage(_shares(points.groupBy("grp", "path").agg(F.count(F.lit(1)).alias("n")), wide))

    def fine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        _, label = _local_fit(x, pdf["weight"].to_numpy(), int(pdf["k"].iloc[0]), seed, max_iter, tol)
        return pd.DataFrame({"grp": pdf["grp"], "vec": pdf["vec"], "label": label + int(pdf["first"].iloc[0])})

    schema = T.StructType([points.schema["grp"], T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("label", T.LongType())])
    parts = []
    for own, ready in leaves:
        held = join_groups(own, ready.select("grp", "path", "k", "first"), ["grp", "path"])
        parts.append(held.where("k > 1").groupBy("grp", "path").applyInPandas(fine, schema))
        parts.append(held.where("k = 1").select("grp", "vec", F.col("first").alias("label")))  # whatever their size
    labelled = cut_lineage(functools.reduce(DataFrame.union, parts)).select(F.col("grp").alias("_grp"), F.col("vec").alias("_vec"), F.col("label").alias(prediction_col))
    same = df[group_col].eqNullSafe(F.col("_grp")) & (df[vec_col].cast("array<double>") == F.col("_vec"))
    return df.join(labelled, same, "left").drop("_grp", "_vec")


def two_level_kmeans(df: DataFrame, vec_col: str, k: int, seed: int = KMEANS_SEED, max_iter: int = 300, tol: float = 1e-4, max_cell: int = 20_000, prediction_col: str = "cluster_id", max_levels: int = 12) -> DataFrame:
    """:func:`tree_kmeans` with all rows in one group."""
    ks = df.sparkSession.createDataFrame([(0, k)], "_group int, k long")
    return tree_kmeans(df.withColumn("_group", F.lit(0)), "_group", vec_col, ks, seed, max_iter, tol, max_cell, prediction_col, max_levels).drop("_group")


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row and the squared distance, over tiles of centres."""
    best, dist = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
    for strip, start, d2 in squared_tiles(x, centres, TILE_CELLS):
        at = d2.argmin(axis=1)
        least = d2[np.arange(len(d2)), at]
        better = least < dist[strip]
        best[strip] = np.where(better, at + start, best[strip])
        dist[strip] = np.where(better, least, dist[strip])
    return best, dist


def _assign_udf(centres: np.ndarray, ids: np.ndarray):
    @F.pandas_udf("struct<cid:bigint, dist:double>")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            if len(s) == 0:
                yield pd.DataFrame({"cid": pd.Series([], dtype="int64"), "dist": pd.Series([], dtype="float64")})
                continue
            best, dist = nearest(np.stack(s.to_numpy()).astype(np.float64), centres)
            yield pd.DataFrame({"cid": ids[best], "dist": np.sqrt(np.maximum(dist, 0.0))})

    return assign.asNondeterministic()


def assign_nearest(
    df: DataFrame,
    vec_col: str,
    centres: DataFrame,
    centre_col: str = "cluster_id",
    centroid_col: str = "centroid",
    out_col: str = "cluster_id",
    dist_col: str = "centre_distance",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Nearest row of ``centres(centre_col, centroid_col)`` for every row of ``df``;
    ties go to the smaller id.

    Centres go out in blocks of at most ``max_broadcast_bytes``; the running best
    is written between blocks, so any number of centres works in bounded memory.
    Without centres, both outputs are null.
    """
    stats = centres.agg(F.count(F.lit(1)).alias("k"), F.max(F.size(centroid_col)).alias("d")).first()
    size = int(stats["k"]) * int(stats["d"] or 0) * 8
    blocks = max(1, -(-size // max_broadcast_bytes))
    out = df.withColumn("_best", F.lit(None).cast("struct<dist:double,cid:bigint>"))
    for b in range(blocks):
        part = centres.where(F.pmod(F.xxhash64(centre_col), F.lit(blocks)) == b) if blocks > 1 else centres
        rows = sorted(part.select(F.col(centre_col).cast("bigint"), centroid_col).collect())
        if not rows:
            continue
        if b:
            out = cut_lineage(out)
        udf = _assign_udf(np.array([r[1] for r in rows], dtype=np.float64), np.array([r[0] for r in rows], dtype=np.int64))
        out = out.withColumn("_new", udf(F.col(vec_col)))
        new = F.struct(F.col("_new.dist").alias("dist"), F.col("_new.cid").alias("cid"))
        out = out.withColumn("_best", F.when(F.col("_best").isNull(), new).otherwise(F.least(F.col("_best"), new))).drop("_new")
    return out.withColumn(out_col, F.col("_best.cid")).withColumn(dist_col, F.col("_best.dist")).drop("_best")


def centroids(df: DataFrame, cluster_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """Mean vector per cluster: ``(cluster, centroid array<double>, n)``.

    One grouped ``Summarizer`` aggregate (array buffers, map-side combined) -
    no explode and no per-dimension aggregate expressions, whatever ``dim``.
    """
    feats = df.select(cluster_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_f"))
    per = feats.groupBy(cluster_col).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_f")).alias("_m")
    )
    return per.select(cluster_col, vector_to_array("_m").alias("centroid"), "n")


def assemble_clusters(
    labelled: DataFrame,
    k_per_lang: DataFrame,
    lang_col: str = "lang",
    cluster_col: str = "cluster_id",
    order_cols: Sequence[str] = ("idx",),
) -> DataFrame:
    """Long-form cluster table: one row per member, plus one row per empty id.

    ``k_per_lang(lang, k)``: every id in ``range(k)`` appears. ``member_pos``
    is the exact 0-based position inside the cluster in input order,
    ``cluster_size`` the member count (0 for an empty cluster). Members are
    never collected into one array here - nest only bounded outputs.
    """
    members = group_positions(
        labelled, [lang_col, cluster_col], list(order_cols), pos_col="member_pos", size_col="cluster_size"
    )
    ids = k_per_lang.select(
        lang_col, F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))).alias(cluster_col)
    )
    return join_groups(ids, members, [lang_col, cluster_col], "left").withColumn(
        "cluster_size", F.coalesce("cluster_size", F.lit(0)).cast("bigint")
    )
