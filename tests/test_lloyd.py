from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import lloyd
from tessera.operators.kmeans import fit_predict_groups, kmeans_fit_predict, tree_kmeans


def table(spark, groups):
    rows = [(g, i, [float(v) for v in x]) for g, pts in groups.items() for i, x in enumerate(pts)]
    return spark.createDataFrame(rows, "g string, idx bigint, vec array<double>")


def blobs(seed, n, d=6, centres=8, spread=1.0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, d))[rng.integers(0, centres, n)] * 4 + rng.normal(size=(n, d)) * spread


def plain_lloyd(x, weight, centres, max_iter, tol):
    """Iterations without any bound."""
    for n in range(1, max_iter + 1):
        label = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([np.average(x[label == c], axis=0, weights=weight[label == c]) if (label == c).any() else centres[c] for c in range(len(centres))])
        moved = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
        centres = new
        if moved <= tol:
            break
    return centres, n


def test_bounds_change_no_label():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(900, 5)), rng.integers(1, 4, 900).astype(float)
    centres = x[:40].copy()
    group = lloyd.centre_groups(centres)
    label, upper, lower, moved = np.zeros(900, dtype=np.int64), np.full(900, np.inf), np.zeros((900, group.max() + 1)), np.zeros(40)
    compared = []
    for _ in range(25):
        label, upper, lower, n = lloyd.lloyd_step(x, label, upper, lower, centres, moved, group)
        compared.append(n)
        exact = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (label == exact.argmin(axis=1)).all()
        assert (upper >= np.sqrt(exact[np.arange(900), label]) * (1 - 1e-9)).all()
        exact[np.arange(900), label] = np.inf
        for g in range(group.max() + 1):
            assert (lower[:, g] <= np.sqrt(exact[:, group == g].min(axis=1, initial=np.inf)) * (1 + 1e-9)).all()
        new = np.array([np.average(x[label == c], axis=0, weights=w[label == c]) if (label == c).any() else centres[c] for c in range(40)])
        moved, centres = np.sqrt(((new - centres) ** 2).sum(axis=1)), new
    assert compared[0] == 900 * 40 and compared[-1] < 0.2 * 900 * 40


def test_fit_equals_plain_iterations_from_the_same_seeds(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 100)  # many blocks
    x = blobs(2, 700)
    df = table(spark, {"a": x})
    _, seeded = fit_predict_groups(df, "g", "vec", {"a": 20}, max_iter=0)
    start = seeded["a"].centres
    assert len(np.unique(start, axis=0)) == 20
    _, fits = fit_predict_groups(df, "g", "vec", {"a": 20}, max_iter=40)
    want, n = plain_lloyd(x, np.ones(len(x)), start, 40, 1e-4)
    assert fits["a"].iterations == n
    assert np.allclose(fits["a"].centres, want, atol=1e-9)
    cost = ((x[:, None, :] - want[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert fits["a"].cost == pytest.approx(cost, rel=1e-3)


def test_groups_are_independent_and_partitioning_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 64)
    groups = {"a": blobs(3, 300), "b": blobs(4, 150), None: blobs(5, 200), "one": np.ones((9, 6))}
    ks = {"a": 12, "b": 5, None: 7, "one": 3}
    df = table(spark, groups)
    named = lambda out: {(r["g"], r["idx"]): r["cluster_id"] for r in out.collect()}
    together, fits = fit_predict_groups(df, "g", "vec", ks)
    again, _ = fit_predict_groups(df.repartition(5).orderBy(F.desc("idx")), "g", "vec", ks)
    assert named(together) == named(again)
    assert set(fits) == {"a", "b", None}
    for g, pts in groups.items():
        own = {i: c for (h, i), c in named(together).items() if h == g}
        if g == "one":
            assert set(own.values()) == {0}
            continue
        alone, _ = fit_predict_groups(df.where(F.col("g").eqNullSafe(F.lit(g))), "g", "vec", {g: ks[g]})
        assert own == {i: c for (_, i), c in named(alone).items()}
        exact = ((pts[:, None, :] - fits[g].centres[None]) ** 2).sum(axis=2)
        assert all(exact[i, c] <= exact[i].min() + 1e-9 for i, c in own.items())


def test_copies_weigh_and_nulls_have_no_label(spark):
    rows = [(i, [0.0, 0.0]) for i in range(50)] + [(50, [1.0, 0.0]), (51, [9.0, 9.0]), (52, [9.0, 8.0]), (53, None)]
    df = spark.createDataFrame(rows, "idx bigint, vec array<double>")
    out, fit = kmeans_fit_predict(df, "vec", 2)
    got = {r["idx"]: r["cluster_id"] for r in out.collect()}
    assert got[53] is None and got[0] == got[50] != got[51] == got[52]
    assert sorted(c[0] for c in fit.clusterCenters()) == pytest.approx([1 / 51, 9.0])
    assert kmeans_fit_predict(df.limit(0), "vec", 3)[0].collect() == []
    assert {r["cluster_id"] for r in kmeans_fit_predict(df.where("idx < 5"), "vec", 3)[0].collect()} == {0}


def test_seeding_gives_exactly_k_and_beats_random(spark):
    x = blobs(6, 2000, centres=40, spread=0.3)
    df = table(spark, {"a": x})
    for k in (2, 40, 700, 2000):
        _, fits = fit_predict_groups(df, "g", "vec", {"a": k}, max_iter=0)
        assert len(np.unique(fits["a"].centres, axis=0)) == k
    cost = lambda init: fit_predict_groups(df, "g", "vec", {"a": 40}, max_iter=30, init=init)[1]["a"].cost
    assert cost("k-means||") < cost("random")


def test_tree_has_every_cluster_and_bounded_cells(spark, monkeypatch):
    from tessera.operators import kmeans

    monkeypatch.setattr(kmeans, "FAN_OUT", 4)
    monkeypatch.setattr(kmeans, "RUN_ROWS", 50)
    monkeypatch.setattr(kmeans, "SPLIT_SAMPLE", 80)
    groups = {"a": blobs(7, 900), "b": blobs(8, 200), None: blobs(9, 30)}
    df = table(spark, groups)
    ks = spark.createDataFrame([("a", 90), ("b", 20), (None, 3)], "g string, k long")
    out = tree_kmeans(df, "g", "vec", ks, max_cell=60).toPandas()
    assert len(out) == 1130
    for g, k in (("a", 90), ("b", 20), (None, 3)):
        own = out[out["g"].isna() if g is None else out["g"] == g]
        assert set(own["cluster_id"]) == set(range(k))
        x = np.stack(own["vec"])
        mean = lambda s: ((np.stack(s) - np.stack(s).mean(axis=0)) ** 2).sum()
        tree = own.groupby("cluster_id")["vec"].apply(mean).sum()
        flat = fit_predict_groups(df.where(F.col("g").eqNullSafe(F.lit(g))), "g", "vec", {g: k})[1][g].cost
        assert tree < 1.5 * flat and len(x) == len(groups[g])
    again = tree_kmeans(df.repartition(3), "g", "vec", ks, max_cell=60).toPandas()
    key = lambda t: {(str(g), i): c for g, i, c in zip(t["g"], t["idx"], t["cluster_id"], strict=True)}
    assert key(out) == key(again)


def test_seeding_by_cells_and_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "SEED_CELL", 60)
    monkeypatch.setattr(lloyd, "MAX_GROUPS", 6)
    x = blobs(10, 600, centres=30, spread=0.3)
    cells = lloyd.seed_cells(x, 150, 1)
    assert len(cells) > 3 and max(len(rows) for rows, _ in cells) <= 60 and sum(n for _, n in cells) == 150
    assert all(1 <= n <= len(rows) for rows, n in cells)
    assert sorted(np.concatenate([rows for rows, _ in cells]).tolist()) == list(range(600))
    assert lloyd.seed_cells(np.zeros((200, 3)), 2, 1)[0][1] == 2  # fewer than the cells: one cell
    df = table(spark, {"a": x})
    _, seeds = fit_predict_groups(df, "g", "vec", {"a": 150}, max_iter=0)
    assert len(np.unique(seeds["a"].centres, axis=0)) == 150
    assert lloyd.centre_groups(seeds["a"].centres).max() + 1 <= 6
    _, fits = fit_predict_groups(df, "g", "vec", {"a": 150}, max_iter=30)
    want, _ = plain_lloyd(x, np.ones(len(x)), seeds["a"].centres, 30, 1e-4)
    assert np.allclose(fits["a"].centres, want, atol=1e-9)


def test_blocks_between_steps_take_no_executor_memory(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 64)
    levels, columns, settle = [], set(), lloyd._Steps.settle

    def recorded(self):
        if self._turn % lloyd.CUT_EVERY:
            levels.append(self.table.storageLevel)
        columns.update(self.table.columns)
        settle(self)

    monkeypatch.setattr(lloyd._Steps, "settle", recorded)
    _, fits = fit_predict_groups(table(spark, {"a": blobs(11, 500)}), "g", "vec", {"a": 30}, max_iter=12)
    assert len(levels) > 8 and all(x.useDisk and not x.useMemory and not x.useOffHeap for x in levels)
    assert not {"ids", "sums"} & columns  # as large as the vectors, and derived from them and the labels
    assert 0 <= fits["a"].skipped[-1] <= 1


def test_blocks_come_in_bounded_batches_in_any_session(spark):
    from tessera.session import BATCH_SETTING, map_arrow

    def sizes(batches):
        for b in batches:
            yield b.from_arrays([[b.num_rows]], names=["n"])

    other = spark.newSession()
    other.conf.unset(BATCH_SETTING)
    blocks = other.range(0, 24, 1, 1).select(F.expr("cast(repeat('x', 1000000) as binary)").alias("x"))
    assert max(r["n"] for r in map_arrow(blocks, sizes, "n long").collect()) <= 5
    other.conf.set(BATCH_SETTING, "16m")  # a bound of its own is kept
    assert max(r["n"] for r in map_arrow(blocks, sizes, "n long").collect()) > 5


def test_a_round_takes_about_k_candidates():
    rng = np.random.default_rng(12)
    n, k = 20_000, 300
    d2, w = rng.exponential(size=n), rng.integers(1, 4, n).astype(float)
    d2[:7] = 0.0  # candidates already
    block = lloyd._row({"fit": 0, "blk": 0}, {"x": np.arange(n, dtype=float), "w": w, "u": rng.random(n), "d2": d2, "near": np.zeros(n, dtype=np.int32)})
    for turn in (1, 2, 3):
        (got,) = lloyd._taken(SimpleNamespace(value={0: k / (w * d2).sum()}), turn, 42)([block])
        taken = np.frombuffer(got.column("v")[0].as_py()).astype(int)
        assert abs(len(taken) - k) < 5 * np.sqrt(k) and taken.min() >= 7
        assert (w * d2)[taken].mean() > 1.5 * (w * d2).mean()


def test_the_driver_holds_a_piece_of_the_centres_at_a_time(spark, monkeypatch):
    from tessera.operators import pieces

    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 64)
    monkeypatch.setattr(lloyd, "SEED_CELL", 100)
    monkeypatch.setattr(lloyd, "PART", 4)
    df = table(spark, {"a": blobs(13, 500), "b": blobs(14, 300)})
    ks = {"a": 90, "b": 40}
    named = lambda out: {(r["g"], r["idx"]): r["cluster_id"] for r in out.collect()}

    def fitted(init):
        out, fits = fit_predict_groups(df, "g", "vec", ks, max_iter=3, init=init)
        return named(out), fits

    whole = {init: fitted(init) for init in ("k-means||", "random")}
    monkeypatch.setattr(pieces, "PIECE_BYTES", 20 * 6 * 8)
    held, sent = [], pieces.Pieces.flush

    def flush(self):
        held.append(sum(len(x) for _, x in self._open))
        return sent(self)

    monkeypatch.setattr(pieces.Pieces, "flush", flush)
    for init, (labels, fits) in whole.items():
        own, cut = fitted(init)
        assert own == labels
        for g, k in ks.items():
            assert np.array_equal(cut[g].centres, fits[g].centres) and cut[g].iterations == fits[g].iterations and cut[g].k == k
            assert len([first for first, _ in cut[g].pieces.each(cut[g].number)]) >= k // 20
    # a block of candidates or a part of the clusters may come on top
    assert max(held) < 2 * 20 + 64 and sum(held) > 500
    spread = cut["a"].table(spark)
    rows = sorted(spread.collect())
    assert [r[0] for r in rows] == list(range(90)) and np.array_equal(np.array([r[1] for r in rows]), cut["a"].centres)
    other = cut["a"].replaced(spread.where("cluster_id % 2 = 1").select("cluster_id", F.transform("centroid", lambda v: v + 1).alias("centroid")))
    assert np.array_equal(other.centres, cut["a"].centres + (np.arange(90) % 2)[:, None])


def test_written_blocks_are_dropped_when_later_ones_are_there(spark, monkeypatch):
    from tessera.session import ensure_checkpoint_dir

    monkeypatch.setattr(lloyd, "BLOCK_ROWS", 64)
    monkeypatch.setattr(lloyd, "CUT_EVERY", 2)
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    _, fits = fit_predict_groups(table(spark, {"a": blobs(15, 400)}), "g", "vec", {"a": 20}, max_iter=7)
    assert fits["a"].iterations > 4
    assert len(set(folder.glob("table-*")) - before) <= 2  # the distinct vectors and their blocks
