import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.kmeans import assemble_clusters, assign_nearest, cluster_count, kmeans_fit_predict


@pytest.mark.parametrize("n,k", [(1, 1), (2, 2), (19, 2), (20, 2), (30, 3), (999, 99)])
def test_cluster_count_rule(spark, n, k):
    assert cluster_count(n) == k
    assert spark.range(1).select(cluster_count(F.lit(n)).alias("k")).first()["k"] == k


def _centres(spark, cents, ids):
    return spark.createDataFrame([(int(i), list(map(float, c))) for i, c in zip(ids, cents, strict=True)], "cluster_id bigint, centroid array<double>")


def test_assign_nearest_blocks_and_tiles_equal_brute_force(spark, monkeypatch):
    from tessera.operators import kmeans

    rng = np.random.default_rng(5)
    pts = rng.normal(size=(200, 6))
    cents = rng.normal(size=(37, 6))
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(pts)], "id bigint, vec array<double>")
    brute = ((pts[:, None, :] - cents[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    ids = [10 * i + 3 for i in range(len(cents))]
    table = _centres(spark, cents, ids)
    for bound in (kmeans.MAX_BROADCAST_BYTES, 6 * 8 * 5):
        named = {r["id"]: r["cluster_id"] for r in assign_nearest(df, "vec", table, max_broadcast_bytes=bound).collect()}
        assert named == {i: ids[int(b)] for i, b in enumerate(brute)}
    monkeypatch.setattr(kmeans, "TILE_CELLS", 500)
    best, dist = kmeans.nearest(pts, cents)
    assert (best == brute).all() and np.allclose(dist, ((pts - cents[brute]) ** 2).sum(axis=1))
    none = assign_nearest(df, "vec", table.limit(0)).first()
    assert none["cluster_id"] is None and none["centre_distance"] is None


def test_kmeans_rows_at_nearest_centre(spark):
    rng = np.random.default_rng(9)
    pts = np.vstack([rng.normal(loc=c, size=(40, 3)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(pts)], "idx bigint, vec array<double>")
    lab, model = kmeans_fit_predict(df, "vec", 3, max_iter=50)
    centres = np.array(model.clusterCenters())
    got = {r["idx"]: r["cluster_id"] for r in lab.collect()}
    nearest = ((pts[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert all(got[i] == nearest[i] for i in range(len(pts)))
    lab2, _ = kmeans_fit_predict(df.repartition(3), "vec", 3, max_iter=50)
    assert got == {r["idx"]: r["cluster_id"] for r in lab2.collect()}  # repeatable


def test_assembly_keeps_empty_ids(spark):
    lab = spark.createDataFrame(
        [("en", 0, 5, "E"), ("en", 0, 3, "C"), ("en", 2, 4, "D")], "lang string, cluster_id int, idx bigint, title string"
    )
    ks = spark.createDataFrame([("en", 4)], "lang string, k bigint")
    out = assemble_clusters(lab, ks).orderBy("cluster_id", "member_pos").collect()
    assert [(r["cluster_id"], r["cluster_size"], r["member_pos"], r["idx"]) for r in out] == [
        (0, 2, 0, 3),
        (0, 2, 1, 5),
        (1, 0, None, None),
        (2, 1, 0, 4),
        (3, 0, None, None),
    ]


def test_kmeans_with_fewer_distinct_points_than_k(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20)] + [(20 + i, [float(i), 0.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "idx bigint, vec array<double>")
    lab, model = kmeans_fit_predict(df, "vec", 25, max_iter=10)
    assert lab.count() == 30
    assert len(model.clusterCenters()) <= 25


def test_single_lang_merge_order(spark):
    from tessera.plans.single_lang import run_single_lang

    idx = [36227, 299809, 14998, 366202, 19276]
    rows = [("en", i, "T", "x", [1.0, 0.0]) for i in idx]
    arts = spark.createDataFrame(rows, "lang string, idx bigint, title string, first_paragraph string, vec array<double>")
    _, by_index = run_single_lang(arts, vec_col="vec", k_override=1, max_iter=5)
    _, by_merge = run_single_lang(arts, vec_col="vec", k_override=1, max_iter=5, order="merge")
    assert [r["idx"] for r in by_index.orderBy("member_pos").collect()] == sorted(idx)
    assert [r["idx"] for r in by_merge.orderBy("member_pos").collect()] == [14998, 19276, 299809, 36227, 366202]


def test_language_with_one_article_gets_one_cluster(spark):
    from tessera.plans.single_lang import run_single_lang

    rows = [("en", i, "T", "x", [float(i), 1.0]) for i in range(30)] + [("de", 7, "W", "y", [0.0, 1.0])]
    arts = spark.createDataFrame(rows, "lang string, idx bigint, title string, first_paragraph string, vec array<double>")
    lab, clusters = run_single_lang(arts, vec_col="vec", max_iter=5)
    de = clusters.where("lang = 'de'").collect()
    assert [(r["cluster_id"], r["cluster_size"], r["idx"]) for r in de] == [(0, 1, 7)]
    assert clusters.where("lang = 'en'").select("cluster_id").distinct().count() == 3


def test_labels_repeat_at_ten_thousand_rows(spark):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(10_000, 8))
    pts[:500] = pts[500:1000]  # copies
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(pts)], "idx bigint, vec array<double>")
    one, m1 = kmeans_fit_predict(df, "vec", 60, max_iter=20)
    two, m2 = kmeans_fit_predict(df.repartition(5), "vec", 60, max_iter=20)
    a, b = ({r["idx"]: r["cluster_id"] for r in x.collect()} for x in (one, two))
    assert a == b and m1.summary.trainingCost == pytest.approx(m2.summary.trainingCost, rel=1e-12)
    assert all(a[i] == a[i + 500] for i in range(500))


def test_two_level_labels_every_row_and_splits_big_cells(spark):
    from tessera.operators.kmeans import two_level_kmeans

    rng = np.random.default_rng(6)
    pts = np.vstack([rng.normal(loc=c, size=(n, 4)) for c, n in ((0, 900), (8, 60), (16, 40))])
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(pts)], "idx bigint, vec array<double>")
    got = two_level_kmeans(df, "vec", 50, max_cell=150).toPandas()
    assert sorted(got["idx"]) == list(range(1000)) and got["cluster_id"].between(0, 49).all()
    assert got["cluster_id"].nunique() > 40
    again = two_level_kmeans(df.repartition(3), "vec", 50, max_cell=150).toPandas()
    assert got.set_index("idx")["cluster_id"].to_dict() == again.set_index("idx")["cluster_id"].to_dict()
    # tighter than one cell per blob
    centre = got.assign(x=list(pts[got["idx"]])).groupby("cluster_id")["x"].apply(lambda s: ((np.stack(s) - np.stack(s).mean(axis=0)) ** 2).sum()).sum()
    blobs = sum(((p - p.mean(axis=0)) ** 2).sum() for p in (pts[:900], pts[900:960], pts[960:]))
    assert centre < 0.7 * blobs
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "idx bigint, vec array<double>")
    assert {r["cluster_id"] for r in two_level_kmeans(same, "vec", 5).collect()} == {0}
    assert two_level_kmeans(same.limit(0), "vec", 5).count() == 0
