import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import collisions, queries
from tests.conftest import SF_ORACLE

SCHEMA = "vec_id long, embedding array<double>, label int"


def asked():
    return F.col("id") % 20 == 0


def brute(rows, k=20, every=20):
    """``(query_id, [(score, vec_id), ...])`` of every query row, by all products."""
    fine = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in fine]
    dim = min(set(sizes), key=lambda d: (-sizes.count(d), d), default=0)
    fine = [(i, v) for i, v in fine if len(v) == dim]
    out = []
    for a, (i, q) in enumerate(fine):
        if i % every == 0:
            out.append((i, sorted(((float((v * q).sum()), j) for b, (j, v) in enumerate(fine) if a != b), key=lambda x: (-x[0], x[1]))[:k]))
    return out


def rows_of(df):
    """``{query_id: [(score, vec_id), ...]}`` by rank; ranks must be 1, 2, ..."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    for own in out.values():
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
    return {q: [(s, v) for _, s, v in own] for q, own in out.items()}


def recall(got, want):
    hits = sum(len({v for _, v in got.get(q, [])} & {v for _, v in own}) for q, own in want)
    return hits / max(1, sum(len(own) for _, own in want))


def test_query_on_the_given_vectors(spark):
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet").collect()]
    vectors = {i: np.array(v, dtype=np.float64) for i, v in given}
    got, want = rows_of(queries.op11_nearest_vectors(spark, SF_ORACLE)), brute(given)
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want}
    assert recall(got, want) >= 0.95
    for q, own in got.items():
        for score, v in own:
            assert score == pytest.approx(float(vectors[q] @ vectors[v]), abs=1e-14)


def made_up(n, dim, seed, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 3
    x = centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dim)) * rng.uniform(0.2, 2.0, n)[:, None]
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]


def test_many_blocks_and_norms_of_every_size(spark):
    """Largest products, not smallest angles: norms differ; many small blocks, several sides."""
    given = made_up(3000, 24, 1)
    df = spark.createDataFrame([(*r, 0) for r in given], SCHEMA)
    got, want = rows_of(collisions.search_nearest(df, asked(), 20, block_rows=128)), brute(given)
    assert recall(got, want) >= 0.95
    assert {q: len(v) for q, v in got.items()} == dict.fromkeys([q for q, _ in want], 20)


def test_far_blocks_are_left_out(spark):
    """Groups far apart: most pairs of blocks never meet, and nothing is lost by it."""
    rng = np.random.default_rng(2)
    centres = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    given = [(i, [float(x) for x in centres[i % 16] + rng.standard_normal(32) * 0.01]) for i in range(4000)]
    df = spark.createDataFrame([(*r, 0) for r in given], SCHEMA)
    scale = collisions.Scale(32, 2.0, 1.0, collisions.PROJECTIONS)
    index, blocks = collisions.build_index(collisions.usable(df, "vec_id", "embedding").withColumn("row", F.col("id")), scale, asked(), 20, 64)
    pairs = collisions.needed_blocks(index, blocks, scale).count()
    assert pairs < 0.5 * blocks * blocks
    assert recall(rows_of(collisions.search_nearest(df, asked(), 20, block_rows=64)), brute(given)) >= 0.95


def test_equal_vectors_go_by_id_and_are_not_dropped(spark):
    rng = np.random.default_rng(3)
    own = [float(x) for x in rng.standard_normal(16)]
    given = [(i, own if i % 3 else [float(x) for x in rng.standard_normal(16)]) for i in range(900)]
    df = spark.createDataFrame([(*r, 0) for r in given], SCHEMA)
    got = rows_of(collisions.search_nearest(df, asked(), 20, block_rows=64))
    for q, want in brute(given):
        if q % 3:  # a copy: its nearest are copies, by id
            assert got[q] == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    given = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (7, []), (5, [-1.0, 0.5]), (5, [-1.0, 0.5]), (140, [3.0, 0.0]), (3, [1e-3, 1e3])]
    df = spark.createDataFrame([(*r, 0) for r in given], SCHEMA).withColumns({c: F.lit("x") for c in ["id", "v", "row", "query", "cell", "blk", "rank", "score", "query_id", "k"]})
    assert rows_of(collisions.search_nearest(df, asked(), 20)) == dict(brute(given))


def test_repeated_query_ids_and_negative_ids(spark):
    given = [(20, [1.0, 0.0]), (20, [0.5, 1.0]), (-20, [1.0, 1.0]), (1, [0.2, 0.9])]
    df = spark.createDataFrame([(*r, 0) for r in given], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in collisions.search_nearest(df, asked(), 20).collect())
    assert got == sorted((q, n + 1, v, round(s, 9)) for q, own in brute(given) for n, (s, v) in enumerate(own))


def test_empty_and_single_row_tables(spark):
    for rows in ([], [(0, None, 1)], [(0, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [2.0, 1.0], 1)]):
        out = collisions.search_nearest(spark.createDataFrame(rows, SCHEMA), asked(), 20)
        assert out.collect() == []
        assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]


def test_threshold_is_a_binomial_quantile():
    p, m = 0.6826894921370859, 64
    t = collisions.threshold(m, 0.03)
    tail = lambda x: sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(x, m + 1))
    assert tail(t) >= 0.97 > tail(t + 1)
