"""Nearest vectors by inner product: collision counting with query-centred windows.

*From products to distances.* With all vectors divided by the largest norm and one
component ``sqrt(1 - |x|^2)`` added (0 for a query, which is divided by its own norm), the
squared distance is ``2 - 2 * q.x``: the largest product is the nearest vector.

*Index.* Every vector is projected on ``PROJECTIONS`` random directions. Vectors are dealt
into blocks of about ``BLOCK_ROWS``, near ones together (the sides of a few projections on
which they lie); a block keeps, for each projection, its values in order and whose they
are, and the least and greatest value.

*Search.* A query's window of radius ``r`` on a projection reaches ``r`` to both sides of
the query's own value. A vector at distance ``r`` falls into it with the chance that a
standard normal is below 1 in size, so one within ``r`` falls into at least ``threshold()``
of all windows with a chance of 1 - ``MISS``. Windows widen by ``GROWTH`` to both sides
(virtual rehashing: no new hash, only new ends in the sorted arrays), and vectors that
reach the threshold for the first time are verified on the original vectors. A query
stops as soon as its radius reaches the distance of the last of its best ``k``: of those
nearer than that, all but ``MISS`` have been verified.

*Rounds.* First each query searches its own block, which bounds its distances. Then it
goes to every block that it can need: a block on which fewer than the threshold of its
windows touch the block's least to greatest value holds no vector with enough collisions.
Query blocks meet data blocks by a join on the block number; a task keeps the best of a
bounded number of queries between blocks. There is no limit on partners or candidates,
and no bucket that can fill up: a hot direction gives more blocks of the same size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.scratch import map_batches, store

PROJECTIONS = 64
#: Chance that a vector as near as the last neighbour found is missed.
MISS = 0.03
GROWTH = 1.15
#: First radius of a query that knows no bound yet.
FIRST_RADIUS = 0.3
BLOCK_ROWS = 2048
#: Vectors whose projections give the sides (medians) that cells are made of: those with the smallest hashes of their ids.
SAMPLE_ROWS = 4096
#: Cells are told apart by at most so many sides.
MOST_SIDES = 16
#: Blocks whose least and greatest values travel together.
CHUNK_BLOCKS = 256
#: Queries whose best a task keeps between blocks.
KEPT_QUERIES = 50_000
#: Windows are this much wider, as projections are kept in single precision.
_ROUNDING = 1e-5
_SLICE = 64


def threshold(m: int = PROJECTIONS, miss: float = MISS) -> int:
    """Most collisions of ``m`` that a vector within the radius reaches with a chance of at least ``1 - miss``."""
    p = 2 * NormalDist().cdf(1.0) - 1
    below = 0.0
    for hits in range(m + 1):
        below += math.comb(m, hits) * p**hits * (1 - p) ** (m - hits)
        if below > miss:
            return hits
    return m


def directions(dim: int, m: int = PROJECTIONS, seed: int = 11) -> np.ndarray:
    """``dim + 1`` by ``m`` random directions; the last row is that of the added component."""
    return np.random.default_rng(seed).standard_normal((dim + 1, m))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, v`` of the rows that take part (see :func:`search_nearest`)."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


class Scale:
    """The numbers that all vectors are seen through: dimension, largest norm, directions."""

    def __init__(self, dim: int, unit: float, norm: float, m: int) -> None:
        self.dim, self.unit, self.norm, self.m = dim, unit, norm, m
        self.directions = directions(dim, m)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Projections of vectors, one row each."""
        x = x / self.unit / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def turned(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Projections of queries, and what turns a product with each into a cosine-like number of at most 1."""
        q = q / self.unit
        size = np.sqrt((q * q).sum(axis=1))
        return (q / size[:, None]) @ self.directions[:-1], 1.0 / (size * self.norm) / self.unit / self.unit


class Block:
    """Sorted projections of a block of vectors: ``values`` of each projection in order, and
    ``rank``, the place that each vector has in them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, values: np.ndarray, rank: np.ndarray) -> None:
        self.ids, self.rows, self.vectors, self.values, self.rank = ids, rows, vectors, values, rank

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, scale: Scale) -> Block:
        places = scale.project(vectors).T.astype(np.float32)
        order = np.argsort(places, axis=1, kind="stable")
        rank = np.empty(order.shape, dtype=_rank_kind(len(ids)))
        np.put_along_axis(rank, order, np.arange(len(ids), dtype=rank.dtype)[None, :], axis=1)
        return cls(ids, rows, vectors, np.take_along_axis(places, order, axis=1), rank)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many of each query's windows ``[low, high)`` of the sorted arrays hold each vector; (queries, vectors)."""
        counts = np.zeros((len(low), len(self.ids)), dtype=np.uint16)
        start, width = low.astype(self.rank.dtype), (high - low).astype(self.rank.dtype)
        for j, rank in enumerate(self.rank):
            counts += rank[None, :] - start[:, j : j + 1] < width[:, j : j + 1]  # below the start it wraps around
        return counts


def _rank_kind(n: int) -> str:
    """Ranks and a window as wide as the block must fit, or a window would wrap to nothing."""
    return "<u2" if n < 1 << 16 else "<u4"


class Best:
    """The best ``k`` of some queries: scores, ids and rows, best first; ``-inf`` where there is none yet."""

    def __init__(self, n: int, k: int) -> None:
        self.score = np.full((n, k), -np.inf)
        self.id = np.zeros((n, k), dtype=np.int64)
        self.row = np.full((n, k), -1, dtype=np.int64)

    def offer(self, i: int, q: np.ndarray, block: Block, at: np.ndarray) -> None:
        """Take the vectors of ``block`` at ``at`` into the best of query ``i``; ties go to the smaller id."""
        k = self.score.shape[1]
        rough = block.vectors[at] @ q
        slack = 1e-9 * max(1e-300, float(np.abs(rough).max(initial=0.0)))
        floor = self.score[i, -1]
        if len(at) > k:
            floor = max(floor, np.partition(rough, len(at) - k)[len(at) - k])
        at = at[rough >= floor - slack]
        if not len(at):
            return
        exact = (block.vectors[at] * q).sum(axis=1)  # the same sum for equal vectors wherever they stand
        score, own, row = np.concatenate([self.score[i], exact]), np.concatenate([self.id[i], block.ids[at]]), np.concatenate([self.row[i], block.rows[at]])
        first = np.lexsort((row, own, -score))[:k]
        self.score[i], self.id[i], self.row[i] = score[first], own[first], row[first]


def _radius(score: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Distance of the last of the best; the largest possible one where fewer are known."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(np.isfinite(score), np.sqrt(np.maximum(0.0, 2.0 - 2.0 * score * turn)), np.inf)


def count_collisions(block: Block, queries: np.ndarray, own: np.ndarray, places: np.ndarray, turn: np.ndarray, best: Best, limit: np.ndarray, enough: int) -> None:
    """Search one block for some queries (their vectors, rows, projections): windows grow
    until their radius reaches the last of ``best``, which is updated, or ``limit``, a
    distance within which each query is known to have its ``k``."""
    m = block.values.shape[0]
    for a in range(0, len(queries), _SLICE):
        active = np.arange(a, min(a + _SLICE, len(queries)))
        seen = block.rows[None, :] == own[active][:, None]  # a query is none of its own answers
        radius = np.where(limit[active] < 2.0, limit[active] / GROWTH, FIRST_RADIUS)
        while len(active):
            left, right = places[active] - radius[:, None] - _ROUNDING, places[active] + radius[:, None] + _ROUNDING
            low = np.stack([np.searchsorted(block.values[j], left[:, j]) for j in range(m)], axis=1)
            high = np.stack([np.searchsorted(block.values[j], right[:, j], side="right") for j in range(m)], axis=1)
            # at a radius beyond all distances everything is a candidate
            fresh = ~seen & ((block.collisions(low, high) >= enough) | (radius >= 2.0)[:, None])
            seen |= fresh
            for x, i in enumerate(active.tolist()):
                found = np.flatnonzero(fresh[x])
                if len(found):
                    best.offer(i, queries[i], block, found)
            last = np.minimum(np.minimum(_radius(best.score[active, -1], turn[active]), limit[active]), 2.0)
            going = radius < last
            active, seen, last = active[going], seen[going], last[going]
            radius = np.minimum(np.maximum(radius[going] * GROWTH, FIRST_RADIUS / 64), last)


def _pack(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build_index(vectors: DataFrame, scale: Scale, is_query: Column, k: int, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Written index of ``vectors(id, v, row)`` and its number of blocks.

    A row per block: ``blk``; ``ids, rows, vectors, places, ranks`` (packed arrays, ``places`` the
    sorted values of each projection and ``ranks`` the vectors' places among them); ``low, high`` per
    projection; and of its queries ``q_rows, q_ids, q_vectors, q_score`` (the score of
    the last of their best ``k`` in this block, ``-inf`` if there are fewer).
    """
    spark, dim, m, enough = vectors.sparkSession, scale.dim, scale.m, threshold(scale.m)
    total = vectors.count()
    sides = min(MOST_SIDES, m, max(0, math.ceil(math.log2(max(1, total) / block_rows))))
    sample = vectors.select("v").orderBy(F.xxhash64("id"), "row").limit(SAMPLE_ROWS).toArrow().column("v").combine_chunks()
    middle = np.median(scale.project(_vectors(sample, dim))[:, :sides], axis=0) if sides else np.zeros(0)
    kind = "<f4" if vectors.schema["v"].dataType.elementType == T.FloatType() else "<f8"

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = scale.project(_vectors(batch.column(1), dim))[:, :sides] > middle
            cell = (side.astype(np.int64) << np.arange(sides)[::-1]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["id", "v", "row", "query", "cell"])

    schema = T.StructType([*vectors.select("id", "v", "row").schema.fields, T.StructField("query", T.BooleanType()), T.StructField("cell", T.IntegerType())])
    placed = store(map_batches(vectors.select("id", "v", "row", is_query.alias("query")), cells, schema), "cells")
    sizes = sorted(placed.groupBy("cell").count().collect())  # at most 2 ** MOST_SIDES rows
    plan, held, blocks = [], 0, 0  # neighbouring cells share a block until it is half full; a large cell has many blocks
    for cell, n in sizes:
        split = max(1, round(n / block_rows))
        if held and held + n <= block_rows:
            plan.append((cell, blocks - 1, 1))
            held += n
        else:
            plan.append((cell, blocks, split))
            blocks, held = blocks + split, n if split == 1 else block_rows
    deal = F.broadcast(spark.createDataFrame(plan, "cell int, first int, split int"))
    dealt = placed.join(deal, "cell").withColumn("blk", (F.col("first") + F.pmod(F.xxhash64("row"), "split")).cast("int"))
    gathered = dealt.groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("row", "id", "query", "v"))).alias("members"))  # about ``block_rows``

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column(1).slice(i, 1).flatten()
                row, own, query, v = (members.field(c) for c in range(4))
                block = Block.build(own.to_numpy(), row.to_numpy(), _vectors(v, dim), scale)
                pick = query.to_numpy(zero_copy_only=False).astype(bool)
                asked, best = block.vectors[pick], Best(int(pick.sum()), k)
                if len(asked):
                    places, turn = scale.turned(asked)
                    count_collisions(block, asked, block.rows[pick], places, turn, best, np.full(len(asked), np.inf), enough)
                packed = [_pack(block.ids, "<i8"), _pack(block.rows, "<i8"), _pack(block.vectors, kind), _pack(block.values, "<f4"), _pack(block.rank, _rank_kind(len(block.ids))), _pack(block.values[:, 0], "<f4"), _pack(block.values[:, -1], "<f4")]
                packed += [_pack(block.rows[pick], "<i8"), _pack(block.ids[pick], "<i8"), _pack(asked, kind), _pack(best.score[:, -1], "<f8")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([x], pa.binary()) for x in packed]], names=names)

    names = ["blk", "ids", "rows", "vectors", "places", "ranks", "low", "high", "q_rows", "q_ids", "q_vectors", "q_score"]
    return store(map_batches(gathered, build, "blk int, " + ", ".join(f"{c} binary" for c in names[1:])), "collision-index"), blocks


def needed_blocks(index: DataFrame, blocks: int, scale: Scale) -> DataFrame:
    """``q_blk, blk``: the data blocks that any query of a query block can need."""
    chunk = F.floor(F.col("blk") / CHUNK_BLOCKS).cast("int")
    bounds = index.select(chunk.alias("chunk"), F.struct("blk", "low", "high").alias("b")).groupBy("chunk").agg(F.collect_list("b").alias("bounds"))  # at most CHUNK_BLOCKS
    every = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // CHUNK_BLOCKS)))
    asked = index.where(F.octet_length("q_rows") > 0).select(F.col("blk").alias("q_blk"), "q_vectors", "q_score", every.alias("chunk"))
    m, dim, enough = scale.m, scale.dim, threshold(scale.m)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                score = np.frombuffer(r["q_score"], "<f8")
                places, turn = scale.turned(_matrix(r["q_vectors"], len(score), dim))
                reach = np.minimum(_radius(score, turn), 2.0)[:, None] + _ROUNDING
                out = []
                for b in r["bounds"]:
                    touched = ((places + reach >= np.frombuffer(b["low"], "<f4")) & (places - reach <= np.frombuffer(b["high"], "<f4"))).sum(axis=1)
                    if ((touched >= min(enough, m)) | (reach[:, 0] >= 2.0)).any():
                        out.append(b["blk"])
                yield pa.RecordBatch.from_arrays([pa.array([r["q_blk"]] * len(out), pa.int32()), pa.array(out, pa.int32())], names=["q_blk", "blk"])

    return store(map_batches(asked.join(bounds, "chunk").select("q_blk", "q_vectors", "q_score", "bounds"), meet, "q_blk int, blk int"), "block-pairs")


def _matrix(packed: bytes, n: int, dim: int) -> np.ndarray:
    """Packed vectors of either precision."""
    return np.frombuffer(packed, "<f4" if len(packed) == 4 * n * dim else "<f8").astype(np.float64).reshape(n, dim)


def search_nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", m: int = PROJECTIONS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` largest inner products of every query.

    Queries are the rows for which ``is_query`` (an expression on the ids, named ``id``) holds;
    candidates are all rows but the query's own. Scores are sums of double
    products of the original components; ties go to the smaller id. With fewer than ``k``
    candidates all of them are returned.

    A row takes part if its id is not null and its vector is not null, not zero, has no
    null or non-finite component, and has the dimension that most such rows have (the
    smaller one of a tie). Ids are whole numbers; rows that repeat an id are rows of their own, as
    answers and as queries. Equal vectors are found or missed like any others.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = store(usable(vectors.withColumn(id_col, F.col(id_col).cast("long")), id_col, vec_col), "usable-vectors")
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == most["d"])
    unit = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    ahead = lambda acc, x: acc + (x.cast("double") / unit) * (x.cast("double") / unit)
    norm = math.sqrt(rows.agg(F.max(F.aggregate("v", F.lit(0.0), ahead))).first()[0])
    scale = Scale(most["d"], float(unit), norm, m)
    numbered = store(rows.withColumn("row", F.monotonically_increasing_id()), "numbered-vectors")
    index, blocks = build_index(numbered, scale, is_query, k, block_rows)
    pairs = needed_blocks(index, blocks, scale)
    asked = index.select(F.col("blk").alias("q_blk"), "q_rows", "q_ids", "q_vectors", "q_score")
    met = pairs.join(asked, "q_blk").join(index.select("blk", "ids", "rows", "vectors", "places", "ranks"), "blk")
    dim, enough = scale.dim, threshold(m)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, Best]] = {}
        loaded, block = None, None

        def done() -> Iterator[pa.RecordBatch]:
            for q_rows, q_ids, best in kept.values():
                i, j = np.nonzero(best.row >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_rows[i], q_ids[i], best.row[i, j], best.id[i, j], best.score[i, j])], names=["q_row", "query_id", "row", "vec_id", "score"])
            kept.clear()

        for batch in batches:
            for x in range(batch.num_rows):
                blk, q_blk = batch.column("blk")[x].as_py(), batch.column("q_blk")[x].as_py()
                get = lambda c: batch.column(c)[x].as_buffer()  # noqa: B023, E731
                if blk != loaded:
                    ids = np.frombuffer(get("ids"), "<i8")
                    block = Block(ids, np.frombuffer(get("rows"), "<i8"), _matrix(get("vectors").to_pybytes(), len(ids), dim), np.frombuffer(get("places"), "<f4").reshape(m, -1), np.frombuffer(get("ranks"), _rank_kind(len(ids))).reshape(m, -1))
                    loaded = blk
                q_rows = np.frombuffer(get("q_rows"), "<i8").copy()
                q = _matrix(get("q_vectors").to_pybytes(), len(q_rows), dim)
                places, turn = scale.turned(q)
                if q_blk not in kept:
                    if sum(len(v[0]) for v in kept.values()) + len(q_rows) > KEPT_QUERIES:
                        yield from done()
                    kept[q_blk] = (q_rows, np.frombuffer(get("q_ids"), "<i8").copy(), Best(len(q_rows), k))
                best = kept[q_blk][2]
                # answers of the query's own block bound its radius everywhere
                count_collisions(block, q, q_rows, places, turn, best, _radius(np.frombuffer(get("q_score"), "<f8"), turn), enough)
        yield from done()

    found = map_batches(met.select("blk", "q_blk", "q_rows", "q_ids", "q_vectors", "q_score", "ids", "rows", "vectors", "places", "ranks"), search, "q_row long, query_id long, row long, vec_id long, score double")
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
