"""Near-duplicate documents by b-bit MinHash.

A document's set: its distinct runs of five words (``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased); with fewer words the whole sequence is its only element.

1. *Sketch*: ``BANDS * ROWS`` minima per document. ``ROWS`` full minima make one
   band key; of every minimum only the low ``BITS`` bits are kept, packed into
   64-bit words.
2. *Classes*: documents with equal sets (128-bit digest of the set) are one class,
   represented by the smallest id. Copies leave the work here.
3. *Candidates*: representatives that share a band key. In each of ``STAR_ROUNDS``
   rounds, every bucket whose members are still in different components gets a
   leader (the smallest id, then one by hash), and only (leader, member) pairs
   are made: n members give n - 1 pairs. The packed signatures are compared by
   bit counts, and the share of equal fields is corrected for chance equality
   (``2 ** -BITS``). Pairs estimated far below the threshold (``MARGIN``, four
   standard errors) are dropped.
4. *Confirmation* on the full sets, then connected components.
5. *The rest*: buckets that are still split. Big ones are cut into blocks, and each
   pair of blocks is a group of its own, so no task gets a whole bucket. A member
   stays only where some partner of another component has a high enough
   estimate and shares no earlier band with it. The groups left are compared on
   the full sets at once: distinct shingles become columns, documents rows of a
   0/1 matrix, and its product with itself holds all intersections. A group
   returns links that connect what it found connected, fewer than it has
   members, never its pairs. The links join the components.

Every pair that shares a band is thus linked, or confirmed to be no link, or already in
one component. At similarity 0.75, a pair shares none of 32 bands of 4
rows with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytescan import BLACK, Words, chunks, flat, mix, odd_constants, span_hashes, window_hashes
from tessera.llm.components import components
from tessera.llm.scratch import map_batches, schema_with, semi_join, store

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 4
SIMILAR = (75, 100)
#: Estimates this far below the threshold are not confirmed: 4 standard errors of 128 fields.
MARGIN = 0.16
STAR_ROUNDS = 3
#: Members of a bucket in one block; two blocks are compared at a time, shingles in tiles.
BLOCK = 256
TILE = 4096

_FIELDS = 64 // BITS
_WORDS = BANDS * ROWS * BITS // 64
_MULTIPLY = odd_constants(BANDS * ROWS, 11).astype(np.uint32) | np.uint32(1)
_ADD = odd_constants(BANDS * ROWS, 13).astype(np.uint32)
_ROW_MIX = odd_constants(ROWS, 17)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end; and where each text starts."""
    words = Words(data, offsets, BLACK)
    hashes = words.hashes()
    run = window_hashes(hashes, SHINGLE)
    inside = words.doc[: len(run)] == words.doc[SHINGLE - 1 : SHINGLE - 1 + len(run)]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    whole = span_hashes(hashes, words.first[short], words.first[short] + words.count[short])
    doc = np.concatenate([words.doc[: len(run)][inside], short])
    value = np.concatenate([run[inside], whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


def minima(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` minima of each non-empty set; (sets, minima) uint32."""
    low = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32)
    out = np.zeros((len(first) - 1, BANDS * ROWS), dtype=np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    x, y = np.empty_like(low), np.empty_like(low)
    for k in range(BANDS * ROWS):
        np.multiply(low, _MULTIPLY[k], out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        np.add(x, _ADD[k], out=x)
        out[full, k] = np.minimum.reduceat(x, first[:-1][full])
    return out


def pack(minimum: np.ndarray) -> np.ndarray:
    """Low ``BITS`` bits of every minimum, ``64 / BITS`` of them per word; (sets, words) int64."""
    low = (minimum & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minimum), _WORDS, _FIELDS)
    return np.bitwise_or.reduce(low << (np.arange(_FIELDS, dtype=np.uint64) * np.uint64(BITS)), axis=2).view(np.int64)


def band_keys(minimum: np.ndarray) -> np.ndarray:
    """One key per band, the band's number mixed in; (sets, bands) int64."""
    rows = minimum.reshape(len(minimum), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(minimum), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key + (rows[:, :, r] + np.uint64(1)) * _ROW_MIX[r])
    return mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = flat(batch.column(1))
        for i, j in chunks(offsets):
            value, first = shingle_sets(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = np.diff(first)
            least = minima(value, first)
            one, two = np.zeros(j - i, dtype=np.uint64), np.zeros(j - i, dtype=np.uint64)
            full = np.flatnonzero(size > 0)
            if len(full):
                one[full] = np.add.reduceat(mix(value), first[:-1][full])
                two[full] = np.add.reduceat(mix(value ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][full])
            arrays = [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
            for block, width in ((band_keys(least), BANDS), (pack(least), _WORDS)):
                arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * width, pa.int32()), pa.array(block.ravel())))
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "one", "two", "keys", "sig"])


def equal_share(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two packed signatures, by bit counts."""
    ones = sum(1 << (BITS * i) for i in range(_FIELDS))
    count = F.lit(0)
    for w in range(_WORDS):
        x = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        any_bit = x
        for s in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, s))
        count = count + F.bit_count(any_bit.bitwiseAND(F.lit(ones)))
    same = 1 - count / F.lit(float(BANDS * ROWS))
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, shingles binary``: full sets (ascending 64-bit hashes) of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                value, first = shingle_sets(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), packed], names=["id", "shingles"])

    rows = semi_join(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), ids, "id")
    return map_batches(rows, run, schema_with(docs.schema[id_col].dataType, "shingles binary"))


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The ``pairs(a, b)`` whose full sets are similar enough."""
    ids = store(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    sets = store(_sets(docs, ids, id_col, text_col), "shingles")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.uint64) for c in (2, 3))
                same = len(np.intersect1d(x, y, assume_unique=True))
                if SIMILAR[1] * same >= SIMILAR[0] * (len(x) + len(y) - same):
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    kind = docs.schema[id_col].dataType
    schema = schema_with(kind, "b long")
    schema.fields[0].name, schema.names[0] = "a", "a"
    schema.fields[1].dataType = kind
    return map_batches(both.select("a", "b", "x", "y"), run, schema).distinct()


def _labelled(rows: DataFrame, label: DataFrame | None, column: str = "id", name: str = "component") -> DataFrame:
    """``rows`` with the component of ``column``; an id without a label is its own."""
    if label is None:
        return rows.withColumn(name, F.col(column))
    known = label.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    return rows.join(known, F.col(column) == F.col("__node"), "left").withColumn(name, F.coalesce("__component", column)).drop("__node", "__component")


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after some more ``links(a, b)``."""
    ends = _labelled(_labelled(links, label, "a", "ca"), label, "b", "cb")
    more = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if label is None:
        return more
    moved = label.join(more.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    old = moved.select("node", F.coalesce("root", "component").alias("component"))
    return store(old.union(more.join(label, "node", "left_anti").select("node", "component")), "components")


def _star_pairs(members: DataFrame, label: DataFrame | None, turn: int, least: float) -> DataFrame:
    """``a < b``: the leader of each split bucket with members of other components, if the estimate is high enough."""
    now = _labelled(members, label)
    order = F.lit(0) if turn == 0 else F.xxhash64("id", F.lit(turn))
    lead = now.groupBy("key").agg(F.min(F.struct(order.alias("order"), "id", "component", "sig")).alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    near = (F.col("component") != F.col("lead.component")) & (equal_share(F.col("sig"), F.col("lead.sig")) >= least)
    return now.join(lead.select("key", "lead"), "key").where(near).select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets (each ascending, distinct)."""
    sizes = [len(x) for x in sets]
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # the others are in no intersection
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.concatenate([[0], (np.diff(column) > 0).astype(np.int64)])) if len(column) else column
    out = np.diag(np.array(sizes, dtype=np.float32))
    np.fill_diagonal(out, 0)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, TILE):
        i, j = np.searchsorted(column, [start, start + TILE])
        tile = np.zeros((len(sets), TILE if column[j - 1] >= start + 64 else 64), dtype=np.float32)
        tile[row[i:j], column[i:j] - start] = 1
        out += tile @ tile.T
    return out


def _group_links(ids: list, component: np.ndarray, sets: list[np.ndarray]) -> list[tuple]:
    """Links (smaller id first) that connect members of different components as the
    similar pairs do; at most one per member."""
    size = np.array([len(x) for x in sets])
    same = intersections(sets)
    alike = SIMILAR[1] * same >= SIMILAR[0] * (size[:, None] + size[None, :] - same)
    alike &= component[:, None] != component[None, :]
    links: list[tuple] = []
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.flatnonzero(alike.any(axis=1)).tolist():
        for j in np.flatnonzero(alike[i, i + 1 :]).tolist():
            a, b = find(i), find(i + 1 + j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((min(ids[i], ids[i + 1 + j]), max(ids[i], ids[i + 1 + j])))
    return links


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every ``(key, lo, hi)`` group of rows that come sorted by group."""
    held: list[pa.RecordBatch] = []

    def links(rows: pa.Table) -> list[tuple]:
        group = np.stack([rows.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
        edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1), [True]]))
        ids, component = rows.column("id").to_pylist(), rows.column("component").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column("shingles")]
        out = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if j - i > 1:
                out += _group_links(ids[i:j], component[i:j], sets[i:j])
        return out

    def result(found: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        kind = like.schema.field("id").type
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], kind), pa.array([b for _, b in found], kind)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = [batch.column(c)[batch.num_rows - 1] for c in ("key", "lo", "hi")]
        if [held[0].column(c)[0] for c in ("key", "lo", "hi")] == keys:
            continue  # one group so far
        rows = pa.Table.from_batches(held).combine_chunks()
        group = np.stack([rows.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
        last = int(np.flatnonzero((group != group[-1]).any(axis=1))[-1]) + 1
        yield result(links(rows.slice(0, last)), batch)
        held = rows.slice(last).to_batches()
    if held:
        yield result(links(pa.Table.from_batches(held).combine_chunks()), held[0])


def _links_across(members: DataFrame, label: DataFrame | None, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """``a, b``: links that connect members of one bucket in different components."""
    now = _labelled(members, label)
    size = now.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("from"), F.max("component").alias("to")).where("from <> to")
    blocks = now.join(size.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    wide = blocks.join(reps.select("id", "keys"), "id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pair = lambda rows: rows.withColumn("other", other).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    left, right = pair(wide).alias("l"), pair(wide).alias("r")
    at = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "lo", "hi")]
    near = (F.col("l.component") != F.col("r.component")) & (equal_share(F.col("l.sig"), F.col("r.sig")) >= least)
    before = F.exists(F.zip_with(F.slice("l.keys", 1, F.col("l.band")), F.slice("r.keys", 1, F.col("r.band")), lambda x, y: x == y), lambda e: e)
    open_ = store(left.join(right, [*at, near, ~before], "left_semi").select("key", "lo", "hi", "id", "component"), "open-members")
    ids = store(open_.select("id").distinct(), "open-ids")
    sets = store(_sets(docs, ids, id_col, text_col), "open-sets")
    grouped = open_.join(sets, "id").select("key", "lo", "hi", "id", "component", "shingles").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")
    kind = docs.schema[id_col].dataType
    return map_batches(grouped, _compare_groups, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles long, component_id`` of every document.

    ``component_id`` is the smallest id reachable over links of similarity 0.75
    or more. Null, empty or blank text: no shingles, linked with nothing, its own
    component. A null id is linked with nothing and has a null component. Rows
    that repeat an id each get a row, judged by their own text. Equal texts are
    linked whatever their number. An empty table gives an empty result; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sketch = store(map_batches(rows, _sketch, schema_with(kind, "n long, one long, two long, keys array<long>, sig array<long>")), "sketch")
    known = sketch.where("n > 0 AND id IS NOT NULL")
    classes = store(known.groupBy("n", "one", "two").agg(F.min("id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("id"), "n", "one", "two"), ["id", "n", "one", "two"], "left_semi")

    banded = reps.select("id", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    members = store(banded.join(shared, "key").join(reps.select("id", "sig"), "id"), "members")
    least = SIMILAR[0] / SIMILAR[1] - MARGIN
    label = None
    for turn in range(STAR_ROUNDS):
        pairs = store(_star_pairs(members, label, turn, least), "stars")
        label = _merged(label, store(_confirmed(pairs, docs, id_col, text_col), "star-links"))
    label = _merged(label, store(_links_across(members, label, reps, docs, id_col, text_col, least), "rest-links"))
    of_row = sketch.select("id", F.col("n").alias("n_shingles"), "n", "one", "two").join(classes, ["n", "one", "two"], "left").withColumn("rep", F.coalesce("rep", "id"))
    return _labelled(of_row, label, "rep").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest id) of each group; all columns
    stay. A null id is its own group and stays."""
    gone = near_duplicates(docs, id_col, text_col).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
