"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Benchmark items become windows of ten consecutive normalised words (an item of
fewer words is one window). The hashes of all windows are broadcast as a bit
table plus a dictionary; every document is scanned window by window with array
operations, each hit is verified on the words themselves, and the words of the
hits can then be cut out, or the documents dropped.

Normalised: A-Z lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

The broadcast is bounded: the benchmark goes out in blocks of at most
``BLOCK_BYTES`` of distinct texts and their ids (or one text), and the documents pass through one scan per block, so
a benchmark of any size is covered without a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import ALNUM, Words, chunks, flat, window_hashes
from tessera.llm.scratch import map_batches, packed, schema_with, store, unpacked

WINDOW = 10
BLOCK_BYTES = 8 << 20
_BITS = 22


class WindowSet:
    """Windows of a block of benchmark items, by size and hash."""

    def __init__(self, ids: list[list[str]], texts: list[bytes], window: int = WINDOW) -> None:
        body = np.frombuffer(b"".join(texts), dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        words = Words(body, at, ALNUM)
        hashes = words.hashes()
        self.items = ids
        self.sizes: dict[int, np.ndarray] = {}
        self.windows: dict[tuple[int, int], dict[bytes, set[int]]] = {}
        for item, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            size = min(window, b - a)
            if not size:
                continue
            table = self.sizes.setdefault(size, np.zeros(1 << (_BITS - 3), dtype=np.uint8))
            got = window_hashes(hashes[a:b], size)
            slot = (got >> np.uint64(64 - _BITS)).astype(np.int64)
            np.bitwise_or.at(table, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
            for i, h in enumerate(got.tolist()):
                self.windows.setdefault((size, h), {}).setdefault(words.text(a + i, a + i + size), set()).add(item)

    def scan(self, words: Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Mark of every word inside a verified window, and ``(word, item)`` of the hits."""
        hashes = words.hashes()
        inside = np.zeros(len(hashes) + 1, dtype=np.int64)
        found: list[tuple[int, int]] = []
        for size, table in self.sizes.items():
            got = window_hashes(hashes, size)
            if not len(got):
                continue
            slot = (got >> np.uint64(64 - _BITS)).astype(np.int64)
            maybe = (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            maybe &= words.doc[: len(got)] == words.doc[size - 1 : size - 1 + len(got)]
            for i in np.flatnonzero(maybe).tolist():
                same = self.windows.get((size, int(got[i])))
                items = same.get(words.text(i, i + size)) if same else None
                if items:
                    inside[i] += 1
                    inside[i + size] -= 1
                    found += [(i, item) for item in items]
        return np.cumsum(inside)[:-1] > 0, found


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[WindowSet]:
    """Window sets of the benchmark, a bounded block of items at a time.

    Equal texts are one, with all their ids, and blocks are dealt finer until none is
    larger than ``block_bytes`` (or a single text). Rows without text or words have no window;
    an item without an id has windows to remove but no name to report.
    """
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.octet_length("text") > 0)
    texts = store(rows.groupBy("text").agg(F.array_sort(F.collect_set("id")).alias("ids")), "benchmark")
    size = F.octet_length("text") + F.coalesce(F.aggregate("ids", F.lit(0), lambda acc, x: acc + F.octet_length(x)), F.lit(0))
    n = 1
    while True:
        block = F.pmod(F.xxhash64("text"), F.lit(n))
        worst = texts.groupBy(block.alias("b")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).where("n > 1").agg(F.max("bytes")).first()[0]
        if (worst or 0) <= block_bytes:
            break
        n *= 2
    for k in range(n):
        got = texts.where(block == k).collect()
        if got:
            yield WindowSet([r["ids"] for r in got], [bytes(r["text"]) for r in got])


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id_col, text binary, n_words, n_hit, items array<string>, spans array<struct<start,end>>``.

    ``spans`` are the byte ranges covered by runs of hit words, ascending;
    ``items`` the distinct ids of benchmark items with an occurring window,
    ascending. A row per input row (repeated rows each get theirs, null ids
    stay null). Null or empty text: no words, no hits. An empty benchmark hits
    nothing; an empty table gives an empty result. Other columns of either
    table are ignored, whatever their names.
    """
    spark = docs.sparkSession
    schema = schema_with(docs.schema[id_col].dataType, "text binary, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("binary").alias("text"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
    )

    def scanner(block):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows: WindowSet = block.value
            for batch in batches:
                body, offsets = flat(batch.column(1))
                for i, j in chunks(offsets):
                    words = Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                    hit, found = windows.scan(words)
                    own = batch.slice(i, j - i)
                    yield _result(own, words, hit, found, windows.items, offsets[i:j] - offsets[i])

        return run

    blocks = benchmark_blocks(benchmark, item_id_col, item_text_col, block_bytes)
    first = True
    for windows in blocks:
        if not first:  # one scan per block: keep the earlier ones' result instead of running them again
            rows = store(rows, "decontam")
        rows = map_batches(rows.select("id", "text", "items", "spans"), scanner(spark.sparkContext.broadcast(windows)), schema)
        first = False
    if first:
        rows = map_batches(rows, scanner(spark.sparkContext.broadcast(WindowSet([], []))), schema)
    return rows.withColumnRenamed("id", id_col)


def _result(own: pa.RecordBatch, words: Words, hit: np.ndarray, found: list[tuple[int, int]], names: list[list[str]], base: np.ndarray) -> pa.RecordBatch:
    n = own.num_rows
    items: list[set[str]] = [set(x) for x in own.column(2).to_pylist()]
    for word, item in found:
        items[int(words.doc[word])].update(names[item])
    earlier = own.column(3).to_pylist()
    if any(earlier):  # spans of earlier blocks join those of this one
        hit = hit.copy()
        for d, spans in enumerate(earlier):
            for s in spans:
                a, b = np.searchsorted(words.start, [base[d] + s["start"], base[d] + s["end"]])
                hit[a:b] = True
    counted = np.concatenate([[0], np.cumsum(hit)])[words.first]
    edge = np.flatnonzero(hit)
    spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
    if len(edge):
        cut = np.flatnonzero((np.diff(edge) > 1) | (words.doc[edge[1:]] != words.doc[edge[:-1]]))
        firsts, lasts = np.concatenate([[edge[0]], edge[cut + 1]]), np.concatenate([edge[cut], [edge[-1]]])
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            d = int(words.doc[a])
            spans[d].append({"start": int(words.start[a] - base[d]), "end": int(words.end[b] - base[d])})
    return pa.RecordBatch.from_arrays(
        [
            own.column(0),
            own.column(1),
            pa.array(words.count, pa.int64()),
            pa.array(np.diff(counted), pa.int64()),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ],
        names=["id", "text", "n_words", "n_hit", "items", "spans"],
    )


def cut_spans(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """Scanned documents with the hit spans removed: ``text_col`` becomes a
    string without them. Null text stays null; nothing else changes."""

    def keep(text: F.Column, spans: F.Column) -> F.Column:  # type: ignore[name-defined]
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("kept"))
        done = F.aggregate(
            spans,
            zero,
            lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("kept")),
        )
        return F.concat(done["kept"], F.substring(text, (done["at"] + 1).cast("int"), F.octet_length(text)))

    return scanned.withColumn(text_col, F.when(F.size("spans") > 0, keep(F.col("text"), F.col("spans"))).otherwise(F.col("text")).cast("string"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay.
    Rows are judged one by one by their text, whatever their id."""
    marked = scan_documents(packed(docs, text_col), benchmark, "row", text_col, item_id_col, item_text_col)
    if text_col != "text":
        marked = marked.withColumnRenamed("text", text_col)
    return unpacked(marked.where(F.col("n_hit") == 0), docs.columns, text_col)
