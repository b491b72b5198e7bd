"""Alignment of two tokenizers by galloping intersection of their token ends.

Tokenizer A (byte-level BPE, a JSON of the ``tokenizers`` library) and B (a
``sentencepiece`` model) cut the same bytes, a space and the text, at different
places. Both lists of end offsets grow strictly, so the offsets at which both
end are an intersection of two sorted lists.

*Galloping.* The shorter list drives: each of its ends is searched in the longer
one from where an end before it was found, in steps of 1, 2, 4, ... until the
longer list has passed it, then by halving inside the last step. It is done for
whole arrays of ends at once: first for widely spaced ends, then for those half
way between them, each from its found predecessor, so the steps are as short as
in a scan and the work is linear in the shorter list.

*Groups and overlaps.* Common ends cut both token lists into groups. The place found
for an end is its rank in the other list, and the difference of the ranks of a
token's two ends is the range of tokens that it overlaps.

*Pair counts.* Two tokens are linked where they end together. A pair can be linked
only if the bytes of one end with the bytes of the other, so all pairs that can
ever occur are known from the two vocabularies (``Vocabularies.most_pairs``, some
324,000 for the public ones, whatever the corpus). Tasks count theirs, the counts
are summed by pair, and the whole table, bounded by that number, goes to every task.

A long text is coded in parts, cut at a single space between two characters that
are not white space; no token of either kind reaches over such a place (checked
for B's vocabulary), so a task holds ``PART_BYTES`` of a text's codes, and the ids of one text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import chunks, flat, segment_sum
from tessera.llm.scratch import map_batches, schema_with, store

PART_BYTES = 1 << 17
#: Links that a task gathers before it sums them by pair.
MEMORY_LINKS = 2_000_000

_SAFE = regex.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"


def default_vocabularies() -> tuple[str, str]:
    """Places of the public byte-level vocabulary and the piece model."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the number of values of ``long`` below it; both grow strictly.

    Exponential, then binary search from the place of a predecessor, for all
    values at odd multiples of a stride at once, the stride halving."""
    n, m = len(short), len(long)
    place = np.zeros(n + 1, dtype=np.int64)  # place[i + 1] is that of short[i]
    stride = 1 << max(0, n - 1).bit_length()
    while stride:
        own = np.arange(stride, n + 1, 2 * stride)
        target, low = short[own - 1], place[own - stride].copy()
        high = np.full(len(own), m)
        live, step = np.arange(len(own)), 1
        while len(live):
            at = low[live] + step - 1
            inside = at < m
            live, at = live[inside], at[inside]
            less = long[at] < target[live]
            high[live[~less]] = at[~less]
            live = live[less]
            low[live] = at[less] + 1
            step *= 2
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = long[middle] < target[live]
            low[live[less]], high[live[~less]] = middle[less] + 1, middle[~less]
            live = live[low[live] < high[live]]
        place[own] = low
        stride >>= 1
    return place[1:]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(start, start + length)``."""
    total = int(length.sum())
    return np.arange(total) + np.repeat(start - np.cumsum(length) + length, length) if total else np.zeros(0, dtype=np.int64)


class Entries:
    """Bytes of a vocabulary's entries by id."""

    def __init__(self, entries: list[bytes]) -> None:
        self.entries = entries
        self.length = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_ranges(self.start[ids], self.length[ids])]


@dataclass
class Aligned:
    """Alignment of the texts of a chunk, end to end; ``*_first`` say where each text
    starts (one entry more than texts). Texts without tokens have none of anything."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    #: Token numbers in ``a`` and ``b`` that end a group (equally many), and where each text's groups start.
    a_cut: np.ndarray
    b_cut: np.ndarray
    cut_first: np.ndarray
    #: For each token of ``a``, the first token of ``b`` that it overlaps and the one behind the last.
    over_first: np.ndarray
    over_end: np.ndarray


def _by_rank(spec: dict, special: dict, entries: list[bytes]) -> bool:
    """Whether ids are ranks, so that ``tiktoken``, which merges by them, codes alike (and faster): the plain
    byte-level word pattern, no normalising, and the n-th merge gives the n-th longer entry."""
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    vocab, pre = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
    longer = sorted(i for t, i in vocab.items() if t not in special and len(entries[i]) > 1)
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    return plain and not spec["model"].get("ignore_merges") and [vocab[a + b] for a, b in merges] == longer


class Vocabularies:
    """Both tokenizers of a worker process, and the bytes of their entries."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        from tessera.llm.bpe import WORD_PATTERN, byte_letters

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        entries = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            if token not in special:
                entries[i] = bytes(letters[c] for c in token)
        self.a = Entries(entries)
        self.tokenizer, self.ranked = None, None
        if _by_rank(spec, special, entries):
            self.ranked = tiktoken.Encoding("ranked", pat_str=WORD_PATTERN, mergeable_ranks={entries[i]: i for t, i in vocab.items() if t not in special}, special_tokens={})
        else:
            self.tokenizer = Tokenizer.from_file(a_path)
            self.tokenizer.encode_special_tokens = True
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        own = self.pieces
        self.b = Entries([bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) or own.is_unknown(i) else own.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(own.get_piece_size())])
        #: Parts are coded apart only if no piece reaches over a space behind another character.
        self.splits = not any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.b.entries)
        self._items = [b"%d," % i for i in range(len(self.a.entries))] + [b"%d|" % i for i in range(len(self.a.entries))]
        self._items += [b"%d," % i for i in range(len(self.b.entries))] + [b"%d;" % i for i in range(len(self.b.entries))]

    def most_pairs(self) -> int:
        """Pairs of entries of which one's bytes end with the other's: all that can end together."""
        a, b = Counter(self.a.entries), Counter(self.b.entries)
        longer = sum(n * a.get(x[i:], 0) for x, n in b.items() for i in range(len(x)))
        return longer + sum(n * b.get(x[i:], 0) for x, n in a.items() for i in range(1, len(x)))

    def _parts(self, text: str) -> list[str]:
        out, at = [], 0
        while self.splits and len(text) - at > PART_BYTES:
            m = _SAFE.search(text, at + PART_BYTES)
            if m is None:
                break
            out.append(text[at : m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids under A and B, end to end, and where each text starts in them."""
        parts = [self._parts(t) for t in texts]
        every = [p for row in parts for p in row]
        first = np.concatenate([[0], np.cumsum([len(row) for row in parts])]).astype(np.int64)
        if self.ranked is not None:
            coded = [self.ranked.encode_ordinary(f" {p}") for p in every]
        else:
            coded = [x.ids for x in self.tokenizer.encode_batch_fast([f" {p}" for p in every], add_special_tokens=False)]
        pieces = self.pieces.encode(every, num_threads=1)

        def joined(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
            total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))])
            return np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int32, count=int(total[-1])), total[first]

        return *joined(coded), *joined(pieces)

    def align(self, raw: list[bytes]) -> Aligned:
        """Alignment of whole texts (UTF-8)."""
        a, a_first, b, b_first = self.encode([x.decode("utf-8", "replace") for x in raw])
        n = len(raw)
        keep = np.array([len(x) > 0 for x in raw], dtype=bool)
        wanted = np.frombuffer(b"".join(b" " + x for x in raw), dtype=np.uint8)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=n) + 1
        at = np.concatenate([[0], np.cumsum(size)])
        for own, ids, first in ((self.a, a, a_first), (self.b, b, b_first)):
            got = segment_sum(own.length[ids], first)
            keep &= got == size
            body, start = own.joined(ids), np.concatenate([[0], np.cumsum(got)])
            if len(body) == len(wanted) and (got == size).all():
                differs = np.add.reduceat(body != wanted, at[:-1]) if n else np.zeros(0)
                keep &= differs == 0
            else:
                for i in np.flatnonzero(keep):
                    keep[i] = np.array_equal(body[start[i] : start[i + 1]], wanted[at[i] : at[i + 1]])
        a, a_first = _kept(a, a_first, keep)
        b, b_first = _kept(b, b_first, keep)
        a_end, b_end = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        place = np.zeros(len(a), dtype=np.int64)  # rank of each end of A in B
        both = np.zeros(len(a), dtype=bool)
        a_shorter = np.diff(a_first) <= np.diff(b_first)
        if len(a):
            for shorter in (True, False):
                docs = a_shorter if shorter else ~a_shorter
                own_a, own_b = np.flatnonzero(np.repeat(docs, np.diff(a_first))), np.flatnonzero(np.repeat(docs, np.diff(b_first)))
                if not len(own_a):
                    continue
                ends_a, ends_b = a_end[own_a], b_end[own_b]
                if shorter:
                    rank = gallop(ends_a, ends_b)
                    hit = ends_b[rank] == ends_a  # the last ends of a text are common, so a rank is inside
                else:
                    back = gallop(ends_b, ends_a)  # ranks in A; those in B follow by counting
                    common = ends_a[back] == ends_b
                    hit = np.zeros(len(ends_a), dtype=bool)
                    hit[back[common]] = True
                    rank = np.cumsum(np.bincount(back, minlength=len(ends_a))) - hit
                place[own_a], both[own_a] = own_b[rank], hit
        a_cut = np.flatnonzero(both)
        b_cut = place[a_cut]
        start_place = np.concatenate([[0], (place + both)[:-1]]) if len(a) else place
        # a token that starts inside another of B overlaps that one; one that starts at a common end, the next
        return Aligned(a, b, a_first, b_first, a_cut, b_cut, np.searchsorted(a_cut, a_first), start_place, place + 1)

    def links(self, x: Aligned) -> np.ndarray:
        """Keys ``a * entries of B + b`` of the linked pairs, in order."""
        return x.a[x.a_cut].astype(np.int64) * len(self.b.entries) + x.b[x.b_cut]

    def group_digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each text's groups ``a1,a2|b1;...``; empty without tokens."""
        na, nb = len(self.a.entries), len(self.b.entries)
        a_group = np.searchsorted(x.a_cut, np.arange(len(x.a)))
        b_group = np.searchsorted(x.b_cut, np.arange(len(x.b)))
        items = np.empty(len(x.a) + len(x.b), dtype=np.int64)
        b_before = np.concatenate([[0], x.b_cut + 1])
        own = x.a.astype(np.int64)
        own[x.a_cut] += na
        items[np.arange(len(x.a)) + b_before[a_group]] = own
        own = x.b.astype(np.int64) + 2 * na
        own[x.b_cut] += nb
        items[np.arange(len(x.b)) + x.a_cut[b_group] + 1] = own
        word, order, cut = self._items.__getitem__, items.tolist(), (x.a_first + x.b_first).tolist()
        return [hashlib.sha256(b"".join(map(word, order[i:j]))[:-1]).hexdigest() if j > i else "" for i, j in zip(cut, cut[1:], strict=False)]


def _kept(ids: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(first)
    return ids[np.repeat(keep, count)], np.concatenate([[0], np.cumsum(np.where(keep, count, 0))])


@functools.lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """One pair of tokenizers per worker process."""
    return Vocabularies(a_path, b_path)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    body, offsets = flat(batch.column(1))
    for i, j in chunks(offsets):
        cut = offsets[i : j + 1].tolist()
        yield i, j, [body[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """``id_col, a_ids, b_ids, a_ends, b_ends, overlap_first, overlap_end`` of every whole text.

    Group ``g`` holds the tokens behind ``a_ends[g - 1]`` up to ``a_ends[g]`` (numbers
    behind each group's last token), and so in B. Token ``i`` of A overlaps the
    tokens ``overlap_first[i]`` up to, without, ``overlap_end[i]`` of B.

    Null and empty texts, and texts whose tokens of A or B do not join to a space and
    the text (say one holding U+2581, which B takes for a space), have empty
    arrays. A row per input row, repeated rows and null ids included; other
    columns are ignored; an empty table gives an empty result.
    """
    a_path, b_path = paths or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(a_path, b_path)
        for batch in batches:
            for i, j, raw in _chunks(batch):
                x = own.align(raw)
                columns = []
                for values, first, base in ((x.a, x.a_first, None), (x.b, x.b_first, None), (x.a_cut + 1, x.cut_first, x.a_first), (x.b_cut + 1, x.cut_first, x.b_first), (x.over_first, x.a_first, x.b_first), (x.over_end, x.a_first, x.b_first)):
                    values = values if base is None else values - np.repeat(base[:-1], np.diff(first))
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["id", "a_ids", "b_ids", "a_ends", "b_ends", "overlap_first", "overlap_end"])

    schema = schema_with(docs.schema[id_col].dataType, "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, overlap_first array<int>, overlap_end array<int>")
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), run, schema).withColumnRenamed("id", id_col)


def link_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """The written table behind :func:`link_counts`: a row per text (``n_a, n_b, groups_sha256`` and
    ``links``, the linked pairs as packed 64-bit keys), and rows with ``pairs`` and ``counts`` of each task."""
    a_path, b_path = paths or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(a_path, b_path)
        gathered: list[np.ndarray] = []
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = None

        def summed() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate(gathered), return_counts=True)
            every, back = np.unique(np.concatenate([pairs, fresh]), return_inverse=True)
            return every, np.bincount(back, np.concatenate([counts, n])).astype(np.int64)

        for batch in batches:
            kind = batch.column(0).type
            for i, j, raw in _chunks(batch):
                x = own.align(raw)
                links = own.links(x)
                gathered.append(links)
                if sum(map(len, gathered)) > MEMORY_LINKS:
                    pairs, counts = summed()
                    gathered.clear()
                n = j - i
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((x.cut_first * 8).astype(np.int32)), pa.py_buffer(links.astype("<i8"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.diff(x.a_first)), pa.array(np.diff(x.b_first)), pa.array(own.group_digests(x), pa.string()), packed, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names
                )
        if gathered:
            pairs, counts = summed()
        if len(pairs):
            one = lambda x: pa.array([x.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), one(pairs), one(counts)], names=names)

    names = ["id", "n_a", "n_b", "groups_sha256", "links", "pairs", "counts"]
    schema = schema_with(docs.schema[id_col].dataType, "n_a long, n_b long, groups_sha256 string, links binary, pairs binary, counts binary")
    return store(map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")), run, schema), "token-links")


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, n``: links corpus-wide of every pair of a :func:`link_table`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(p, "<i8")), pa.array(np.frombuffer(c, "<i8"))], names=["pair", "n"])

    return map_batches(links.where("pairs IS NOT NULL").select("pairs", "counts"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text.

    A link joins a token of A and one of B that end at the same byte; ``n_best`` are those
    whose pair has the highest count that its B id has in the corpus (ties
    included), ``count_sum`` adds up the counts of all. Texts without tokens, odd
    rows and tables: as in :func:`align_tokens`, with zeros and an empty digest.
    """
    a_path, b_path = paths or default_vocabularies()
    own = vocabularies(a_path, b_path)
    width, most = len(own.b.entries), own.most_pairs()
    links = link_table(docs, id_col, text_col, (a_path, b_path))
    rows = pair_counts(links).toArrow()  # at most ``most_pairs`` rows, known from the vocabularies alone
    if rows.num_rows > most:
        raise ValueError(f"{rows.num_rows} linked pairs, but the vocabularies allow {most}")
    pair, n = rows.column("pair").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    best = np.zeros(width, dtype=np.int64)
    np.maximum.at(best, pair % width, n)
    sent = docs.sparkSession.sparkContext.broadcast((pair, n, n == best[pair % width]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, top = sent.value
        for batch in batches:
            body, offsets = flat(batch.column(4))
            first = offsets // 8
            at = np.searchsorted(known, np.frombuffer(body.tobytes(), "<i8"))
            size = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(size), pa.array(size), pa.array(segment_sum(top[at].astype(np.int64), first)), pa.array(segment_sum(count[at], first)), batch.column(3)],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    schema = schema_with(docs.schema[id_col].dataType, "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return map_batches(links.where("pairs IS NULL").select("id", "n_a", "n_b", "groups_sha256", "links"), run, schema).withColumnRenamed("id", id_col)
