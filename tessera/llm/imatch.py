"""I-Match document fingerprints over several randomised lexicons.

The lexicon: terms whose inverse document frequency ``ln(N / df)`` lies in a
band, so neither function words nor one-off words count. A document's distinct
lexicon terms are sorted and hashed, once per randomised subset of the lexicon:
a small edit leaves the subsets alone that hold none of the changed terms. The
subsets thin out level by level (1/4, 1/16, ... of the lexicon, ``COPIES``
independent ones per level), so that short and long documents alike have
subsets that select a few of their terms. Likeness of two fingerprints: the
share of equal subset hashes on the levels that select few terms.

The upper end of the band bounds the lexicon: at most (mean distinct terms of a
document) / ``MIN_SHARE`` terms can be in so many documents, whatever the corpus
size. That is what makes it fit to be broadcast.

A text with fewer than ``MIN_TERMS`` lexicon terms is fingerprinted by all its
terms, one without words by nothing (all hashes zero).
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import ALNUM, Words, chunks, flat, mix, odd_constants
from tessera.llm.scratch import map_batches, schema_with

#: The band as shares of documents: inverse document frequencies ln(1 / 0.05) = 3.0 to ln(1 / 0.001) = 6.9.
MIN_SHARE, MAX_SHARE = 0.001, 0.05
MIN_TERMS = 3
LEVELS, COPIES = 5, 24

_SEEDS = odd_constants(COPIES, 23)


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of each text, ascending, end to end; and where each text starts."""
    words = Words(data, offsets, ALNUM)
    value = words.hashes()
    order = np.lexsort((value, words.doc))
    doc, value = words.doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(offsets)))


@dataclass
class Lexicon:
    """Sorted hashes of the terms in the band, with a bit table in front."""

    terms: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, terms: np.ndarray) -> Lexicon:
        terms = np.sort(terms.astype(np.uint64))
        bits = np.zeros(1 << 24, dtype=bool)
        bits[(terms >> np.uint64(40)).astype(np.int64)] = True
        return cls(terms, np.packbits(bits, bitorder="little"))

    def holds(self, value: np.ndarray) -> np.ndarray:
        slot = (value >> np.uint64(40)).astype(np.int64)
        out = (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        maybe = np.flatnonzero(out)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.terms, value[maybe]), len(self.terms) - 1)
            out[maybe] = self.terms[at] == value[maybe]
        return out


def build_lexicon(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> Lexicon:
    """Lexicon of ``docs``: document frequencies over all of them, counted per
    task first. Texts without words count as documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def reduced() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held])
            n = np.concatenate([n for _, n in held])
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        for batch in batches:
            body, offsets = flat(batch.column(0))
            for i, j in chunks(offsets):
                value, _ = distinct_terms(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(np.unique(value, return_counts=True))
                total += len(held[-1][0])
                if total > 2_000_000:  # merge, and pass on what would not fit
                    keys, n = reduced()
                    if len(keys) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])
                        held, total = [], 0
                    else:
                        held, total = [(keys, n)], len(keys)
        if total:
            keys, n = reduced()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])

    counts = map_batches(docs.select(F.col(text_col).cast("binary").alias("text")), run, "term long, n long")
    n = docs.count()
    band = counts.groupBy("term").agg(F.sum("n").alias("df")).where((F.col("df") >= min_share * n) & (F.col("df") <= max(1.0, max_share * n)))
    return Lexicon.of(band.select("term").toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64))


def subset_hashes(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(texts, LEVELS * COPIES) 16-bit hashes; 0 for a subset that selects nothing."""
    value, first = distinct_terms(data, offsets)
    inside = lexicon.holds(value)
    count = np.concatenate([[0], np.cumsum(inside)])[first]
    few = np.diff(count) < MIN_TERMS
    inside |= np.repeat(few, np.diff(first))
    count = np.concatenate([[0], np.cumsum(inside)])
    value, first = value[inside], count[first]
    out = np.zeros((len(first) - 1, LEVELS * COPIES), dtype=np.uint16)
    for c in range(COPIES):
        x = mix(value * _SEEDS[c])
        at = np.arange(len(x))
        for level in range(LEVELS):
            at = at[x[at] >> np.uint64(62 - 2 * level) == 0]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x[at]))])
            edge = np.searchsorted(at, first)
            some = edge[1:] > edge[:-1]
            h = (mix(total[edge[1:]] - total[edge[:-1]]) >> np.uint64(48)).astype(np.uint16)
            out[:, level * COPIES + c] = np.where(some, h | np.uint16(1), 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each row of two fingerprint matrices; equal fingerprints give 1."""
    either = ((a != 0) | (b != 0)).reshape(-1, LEVELS, COPIES)
    equal = ((a == b) & (a != 0)).reshape(-1, LEVELS, COPIES)
    base, same = either.sum(axis=2), equal.sum(axis=2)
    # levels from the first on which some subset selects nothing of either text; the thinnest level always counts
    few = np.maximum.accumulate(base < COPIES, axis=1)
    few[:, -1] = True
    total = (base * few).sum(axis=1)
    out = np.where(total > 0, (same * few).sum(axis=1) / np.maximum(total, 1), 0.0)
    return np.where((a == b).all(axis=1), 1.0, out)


def as_text(hashes: np.ndarray) -> list[str]:
    """Fingerprints as strings: four hex digits per subset."""
    raw = hashes.astype(">u2").tobytes().hex()
    width = hashes.shape[1] * 4
    return [raw[k : k + width] for k in range(0, len(raw), width)]


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fingerprints(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint string`` of every whole text; null counts as empty.

    Equal texts have equal fingerprints. A row per input row (repeats and null
    ids included); other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                got = subset_hashes(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(as_text(got), pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, run, schema_with(docs.schema[id_col].dataType, "fingerprint string")).withColumnRenamed("id", id_col)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket, ahead, id, text``: sorted inside each bucket, buckets whole in one partition.

    Bucket bounds are rows of the table, the first ones of a range partitioning of its
    ids and text hashes (no texts move for it), so the first document of every bucket is
    known; a copy of it (``ahead``) closes the bucket before, and the smallest id closes the
    last. Every row thus finds its successor in its own partition, with one shuffle of the
    texts. Ids may be of any type that sorts. Rows of equal id are ordered by the hash of
    their text, so a repeated or null id is no hot bucket; null ids come first.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.struct(F.col("id").isNotNull().alias("has"), "id", "h")
    ranged = rows.select("id", "h").repartitionByRange(n, F.col("id").asc_nulls_first(), "h")
    bounds = sorted(tuple(r["k"]) for r in ranged.groupBy(F.spark_partition_id()).agg(F.min(key).alias("k")).collect())  # one row a bucket
    least = next(iter(rows.where(F.col("id").isNotNull()).agg(F.min(key).alias("k")).collect()))["k"]
    sent = spark.sparkContext.broadcast((bounds, None if least is None else tuple(least)))

    @F.arrow_udf("array<struct<bucket:int, ahead:boolean>>")
    def places(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        every, smallest = sent.value
        out = []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True):
            own = (i is not None, i, h)
            at = bisect.bisect_right(every, own) - 1
            here = [{"bucket": at, "ahead": False}]
            if at > 0 and every[at] == own:
                here.append({"bucket": at - 1, "ahead": True})
            if own == smallest:
                here.append({"bucket": len(every) - 1, "ahead": True})
            out.append(here)
        return pa.array(out, pa.list_(pa.struct([("bucket", pa.int32()), ("ahead", pa.bool_())])))

    dealt = rows.select(F.explode(places("id", "h")).alias("at"), "id", "h", "text").select("at.*", "id", "h", "text")
    return dealt.repartitionById(max(1, len(bounds)), F.col("bucket")).sortWithinPartitions("bucket", "ahead", F.col("id").asc_nulls_first(), "h", "text")


def compared_with_next(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's.

    Edited: the last quarter of the code points (rounded down) replaced by as
    many from the start of the next document by ascending id (the first after
    the last). Columns: ``id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. A lone document is its own
    next; equal ids (of any type that sorts) follow each other by the hash of their
    text; null ids come first and the circle closes at the smallest id that is not null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = schema_with(docs.schema[id_col].dataType, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def judged(rows: list[tuple], more: bool) -> pa.RecordBatch:
        """Rows ``(bucket, ahead, id, text)`` but, if there are more to come, the last."""
        lexicon = shared.value
        whole = subset_hashes(*_flat([r[3] for r in rows]), lexicon)
        mine, after, sizes, edited = [], [], [], []
        for k in range(len(rows) - (1 if more else 0)):
            if rows[k][1]:
                continue
            text = rows[k][3].decode("utf-8", "replace")
            follows = k + 1 if k + 1 < len(rows) and rows[k + 1][0] == rows[k][0] else k
            quarter = len(text) // 4
            # a code point has at most four bytes: no need to decode more of the next text
            start = rows[follows][3][: 4 * quarter].decode("utf-8", "ignore")[:quarter]
            mine.append(k)
            after.append(follows)
            sizes.append(len(text))
            edited.append((text[: len(text) - quarter] + start).encode())
        changed = subset_hashes(*_flat(edited), lexicon)
        own, following = whole[np.array(mine, dtype=np.int64)], whole[np.array(after, dtype=np.int64)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in mine], id_type),
                pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array(as_text(own), pa.string()),
                pa.array(as_text(changed), pa.string()),
                pa.array(likeness(own, changed), pa.float64()),
                pa.array(likeness(own, following), pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            body, offsets = flat(batch.column(3))
            for i, j in chunks(offsets, 1 << 20):
                raw, cut = body[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                part = [batch.column(c).slice(i, j - i).to_pylist() for c in range(3)]
                held += [(*r, raw[a:b]) for *r, a, b in zip(*part, cut, cut[1:], strict=False)]
                if len(held) > 1:
                    yield judged(held, True)
                    held = held[-1:]
        if held:
            yield judged(held, False)

    ordered = in_order(docs, id_col, text_col).select("bucket", "ahead", "id", "text")
    return map_batches(ordered, run, schema).withColumnRenamed("id", id_col)
