"""Near-duplicate line removal by a deletion-neighbourhood join.

Every line that is not blank is compared. Two lines are the same for this
operator if their words (A-Z lower-cased, split at white space) are equal, or one
edit (``EDITS``) apart: an inserted, deleted or replaced word where both have
``NEAR_WORDS`` words; in shorter lines, and so in text written without spaces, an
inserted, deleted or replaced character (of the words joined by single spaces)
where both have ``NEAR_CHARS`` characters. A line goes if an *earlier* line (by
document id, then line number) is the same; the earliest stays.

The join, on distinct lines only (units are the words or characters compared):

1. *Who can have a partner.* With one edit, either the first or the second half
   of the shorter line survives in the longer. Lines that share neither half
   with another line leave the work here; most of a corpus does.
2. *Deletion variants.* Each remaining line emits its own hash and the hash of
   every variant with one unit left out. Two lines are within one edit exactly
   if they emit an equal variant at the same place (replacement), or one's
   variant is the other's whole line (insertion, deletion).
3. *Earliest partner.* Only the earliest line of each equal key is paired with
   the others, so a group of n lines gives n - 1 pairs, never n * n.
4. *Verification* of the edit distance on the words or characters of both lines.

Keys are reduced with partial aggregates (minimum, maximum) before they are
shuffled, so a key shared by a third of all lines is no hot task. What makes a line
go is told by two independent 64-bit hashes of its words (``h``, ``g``): no line goes
for one that merely shares the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import BLACK, Words, chunks, flat, mix, place_values, span_hashes
from tessera.llm.scratch import map_batches, packed, schema_with, semi_join, store, unpacked

EDITS = 1
NEAR_WORDS = 8
NEAR_CHARS = 24
#: Share of its words that a document keeps if it stays.
LEAST_LEFT = 0.2


class Units:
    """Lines as runs of units (word hashes or code points); ``kind`` keeps the keys of the two apart."""

    def __init__(self, units: np.ndarray, first: np.ndarray, stop: np.ndarray, kind: int) -> None:
        self.units, self.first, self.stop, self.kind = units, first, stop, np.uint64(kind)
        self.count = stop - first

    def half_keys(self) -> np.ndarray:
        """Four keys of each line: both halves as the shorter line of a pair (or an
        equally long one), and as the longer one."""
        out = []
        for shorter in (self.count, self.count - 1):
            half = shorter // 2
            for side, (a, b) in enumerate(((self.first, self.first + half), (self.stop - (shorter - half), self.stop))):
                out.append(mix(span_hashes(self.units, a, b) + (shorter * 4 + side * 2).astype(np.uint64) + self.kind))
        return np.stack(out, axis=1) if len(self.first) else np.zeros((0, 4), np.uint64)

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(line, place, key)``: place -1 is the whole line, place i the line without unit i."""
        line = np.repeat(np.arange(len(self.first)), self.count)
        place = np.arange(len(line)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        own = self.units[np.repeat(self.first, self.count) + place]
        running = lambda values: np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        here, before = running(place_values(own, place)), running(place_values(own, np.maximum(place, 1) - 1))
        end = np.cumsum(self.count)
        start = end - self.count
        at = np.arange(len(line))
        # what stands before unit i keeps its place, what follows moves up by one
        key = here[at] - here[start[line]] + before[end[line]] - before[at + 1]
        whole = here[end] - here[start]
        length = np.concatenate([self.count, self.count[line] - 1]).astype(np.uint64)
        key = mix(np.concatenate([whole, key]) + length * np.uint64(2) + self.kind)
        return np.concatenate([np.arange(len(self.first)), line]), np.concatenate([np.full(len(self.first), -1), place]), key


class Lines:
    """Lines of a chunk of texts: first word, word count, row and number in its text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        words = Words(data, offsets, BLACK)
        self.words, self.hashes = words, words.hashes()
        breaks = np.flatnonzero(data == 10)
        before = np.searchsorted(breaks, words.start)
        line = before + words.doc
        new = np.ones(len(line), dtype=bool)
        new[1:] = line[1:] != line[:-1]
        self.first = np.flatnonzero(new)
        self.stop = np.append(self.first[1:], len(line)) if len(line) else self.first
        self.count = self.stop - self.first
        self.row = words.doc[self.first]
        self.number = before[self.first] - np.searchsorted(breaks, offsets[:-1])[self.row]

    def keys(self, lane: int = 0) -> np.ndarray:
        return span_hashes(self.hashes if lane == 0 else self.words.hashes(lane), self.first, self.stop, lane)

    def by_words(self) -> tuple[np.ndarray, Units]:
        """The lines compared by words, and their words."""
        at = np.flatnonzero(self.count >= NEAR_WORDS)
        return at, Units(self.hashes, self.first[at], self.stop[at], 0)

    def by_chars(self) -> tuple[np.ndarray, Units]:
        """The lines compared by characters, and these: words joined by single spaces."""
        w = self.words
        few = np.flatnonzero(self.count < NEAR_WORDS)
        room = w.end[self.stop[few] - 1] - w.start[self.first[few]]
        few = few[room >= NEAR_CHARS]  # as bytes, so at least as characters
        texts = [w.text(a, b).decode("utf-8", "replace") for a, b in zip(self.first[few].tolist(), self.stop[few].tolist(), strict=True)]
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        keep = size >= NEAR_CHARS
        points = np.frombuffer("".join(t for t, k in zip(texts, keep.tolist(), strict=True) if k).encode("utf-32-le"), dtype=np.uint32)
        stop = np.cumsum(size[keep])
        return few[keep], Units(points, stop - size[keep], stop, 1)


def _line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line, h, g, halves`` of every line that is not blank."""
    schema = schema_with(docs.schema[id_col].dataType, "line int, h long, g long, halves array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                lines = Lines(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                halves = np.zeros((len(lines.first), 4), dtype=np.int64)
                use = np.zeros(halves.shape, dtype=bool)
                for (at, units), least in ((lines.by_words(), NEAR_WORDS), (lines.by_chars(), NEAR_CHARS)):
                    halves[at], use[at] = units.half_keys().view(np.int64), True
                    use[at[units.count == least], 2:] = False  # as the longer line it would need a partner that is too short
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(i + lines.row)),
                        pa.array(lines.number, pa.int32()),
                        pa.array(lines.keys().view(np.int64)),
                        pa.array(lines.keys(1).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(use.sum(axis=1))]), pa.int32()), pa.array(halves[use])),
                    ],
                    names=["id", "line", "h", "g", "halves"],
                )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, run, schema)


def _line_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``h, g, words`` (lower-cased, single spaces) of the lines ``wanted(id, line, h, g)``."""
    ids = wanted.select(F.col("id").alias(id_col)).distinct()
    rows = semi_join(docs.select(id_col, F.col(text_col).cast("binary").alias("text")), ids, id_col).withColumnRenamed(id_col, "id")
    per_doc = wanted.groupBy("id").agg(F.collect_list(F.struct("line", "h", "g")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = flat(batch.column(0))
            asked = batch.column(1)
            for i, j in chunks(offsets):
                lines = Lines(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                place = {(r, n): k for k, (r, n) in enumerate(zip(lines.row.tolist(), lines.number.tolist(), strict=True))}
                h, g, text = [], [], []
                for r, own in enumerate(asked.slice(i, j - i).to_pylist()):
                    for x in own:
                        k = place.get((r, x["line"]))
                        if k is not None:  # a repeated id may belong to another text
                            h.append(x["h"])
                            g.append(x["g"])
                            text.append(lines.words.text(int(lines.first[k]), int(lines.stop[k])))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(text, pa.binary())], names=["h", "g", "words"])

    return map_batches(rows.join(per_doc, "id").select("text", "lines"), run, "h long, g long, words binary")


def _variants(lines: DataFrame) -> DataFrame:
    """``h, place, key`` of every deletion variant of ``lines(h, words)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = flat(batch.column(1))
            h = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets, 1 << 19):
                got = Lines(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for at, units in (got.by_words(), got.by_chars()):
                    line, place, key = units.variants()
                    yield pa.RecordBatch.from_arrays([pa.array(h[i + got.row[at[line]]]), pa.array(place, pa.int32()), pa.array(key.view(np.int64))], names=["h", "place", "key"])

    return map_batches(lines, run, "h long, place int, key long")


def within_one_edit(a: list[bytes] | str, b: list[bytes] | str) -> bool:
    """Whether two sequences are at most one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def near(a: bytes, b: bytes) -> bool:
    """Whether two lines (words joined by single spaces) are one edit apart, by words or by characters."""
    x, y = a.split(b" "), b.split(b" ")
    if min(len(x), len(y)) >= NEAR_WORDS:
        return within_one_edit(x, y)
    p, q = a.decode("utf-8", "replace"), b.decode("utf-8", "replace")
    return max(len(x), len(y)) < NEAR_WORDS and min(len(p), len(q)) >= NEAR_CHARS and within_one_edit(p, q)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        good = pa.array([k for k in range(len(a)) if near(a[k], b[k])], pa.int64())
        yield batch.select([0, 1, 2]).take(good)


def _near_lines(docs: DataFrame, table: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``h, g, by`` of the distinct lines that an earlier, different line is one edit away
    from, and the smallest document of such lines."""
    halves = table.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    possible = first.join(halves.join(shared, "half", "left_semi").select("h").distinct(), "h", "left_semi")
    texts = store(_line_texts(docs, possible.select("h", "g", F.col("first.id").alias("id"), F.col("first.line").alias("line")), id_col, text_col).dropDuplicates(["h"]), "lines")

    variants = _variants(texts.select("h", "words"))
    equal = variants.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    rows = store(variants.join(equal, "key", "left_semi").join(first, "h").select("key", "place", F.struct("first", "h").alias("at")), "variants")
    cut, whole = rows.where("place >= 0"), rows.where("place < 0").select("key", F.col("at").alias("whole"))
    earliest = cut.groupBy("key", "place").agg(F.min("at").alias("other"))
    pair = lambda late, early: (F.col(f"{late}.h").alias("h"), F.col(f"{early}.h").alias("o"), F.col(f"{early}.first.id").alias("by"))
    replaced = cut.join(earliest, ["key", "place"]).where("other < at").select(*pair("at", "other"))
    longer = cut.join(whole, "key").where("whole < at").select(*pair("at", "whole"))
    shorter = cut.groupBy("key").agg(F.min("at").alias("other")).join(whole, "key").where("other < whole").select(*pair("whole", "other"))
    pairs = replaced.union(longer).union(shorter).distinct()
    both = pairs.join(texts.withColumnRenamed("words", "a"), "h").join(texts.select(F.col("h").alias("o"), F.col("words").alias("b")), "o")
    schema = schema_with(docs.schema[id_col].dataType, "h long, g long")
    return map_batches(both.select(F.col("by").alias("id"), "h", "g", "a", "b"), _verify, schema).groupBy("h", "g").agg(F.min("id").alias("by"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, exact, near, own``, arrays of line numbers (from 0) that go, for documents
    that lose any. ``exact``: an equal line is earlier; ``near``: only a line one edit
    away is; ``own``: those of both that only lines of the same document make go.

    Rows with a null id or text neither lose lines nor count as earlier. Rows
    that repeat an id are one document: equal-numbered lines share one fate.
    An empty table gives an empty result; other columns are ignored.
    """
    table = store(_line_table(docs, id_col, text_col), "line-hashes")
    first = store(table.groupBy("h", "g").agg(F.min(F.struct("id", "line")).alias("first")), "first-lines")
    near = store(_near_lines(docs, table, first, id_col, text_col), "near-lines")
    judged = first.join(near, ["h", "g"], "left")
    gone = (
        table.select("id", "line", "h", "g")
        .join(judged, ["h", "g"])
        .select("id", "line", (F.struct("id", "line") != F.col("first")).alias("exact"), F.col("by").isNotNull().alias("near"), (F.least("first.id", "by") == F.col("id")).alias("own"))
        .where("exact OR near")
    )
    lines = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("line"))))
    return gone.groupBy("id").agg(lines(F.col("exact")).alias("exact"), lines(~F.col("exact")).alias("near"), lines(F.col("own")).alias("own")).withColumnRenamed("id", id_col)


def without_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the other columns of ``docs`` in one struct, so no name can clash), the text rebuilt
    from the lines that stay, the counts ``exact_lines`` and ``near_lines`` of removed
    ones, and, of texts that lost any, ``words`` (without the lines that repeat the
    text's own) and ``words_left``."""
    lost = gone.select(F.col(id_col).alias("__id"), F.size("exact").cast("long").alias("exact_lines"), F.size("near").cast("long").alias("near_lines"), F.concat("exact", "near").alias("__gone"), F.col("own").alias("__own"))
    rows = packed(docs, text_col).withColumnRenamed(text_col, "__text")
    joined = rows.join(lost, F.col(f"row.`{id_col}`") == F.col("__id"), "left")
    without = lambda lines: F.array_join(F.filter(F.split("__text", "\n", -1), lambda _, i: ~F.array_contains(lines, i)), "\n")
    words = lambda t: F.when(F.col("__gone").isNotNull(), F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")))
    text, zero = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(without("__gone")), F.lit(0).cast("long")
    return joined.select("row", text.alias(text_col), F.coalesce("exact_lines", zero).alias("exact_lines"), F.coalesce("near_lines", zero).alias("near_lines"), words(without("__own")).alias("words"), words(text).alias("words_left"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_left: float = LEAST_LEFT) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; all columns stay.

    A document that lost lines goes as a whole if no word is left, or less than ``least_left``
    of the words that it does not say twice itself: what remains of a near copy is its
    few differences, not a text.
    """
    left = without_lines(docs, repeated_lines(docs, id_col, text_col), id_col, text_col)
    scrap = (F.col("words_left") == 0) | (F.col("words_left") < least_left * F.col("words"))
    return unpacked(left.where(~F.coalesce(scrap, F.lit(False))), docs.columns, text_col)
