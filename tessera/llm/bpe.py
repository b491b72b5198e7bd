"""BPE encoding and decoding by speculation and verification.

*Speculate*: every distinct word of a chunk is cut greedily into the longest
vocabulary entries, all words at once (one trie step per array operation).
*Verify*: a token sequence is what the merges produce exactly when every
adjacent pair of it is what the merges produce for the pair's own bytes, so
the distinct adjacent pairs are looked up in an array of pairs already judged;
unseen pairs are judged once by merging their bytes. *Repair*: only words with
a failing pair (or a token that the merges never build) are merged exactly,
again many words per array operation.

The vocabulary file is a parameter (JSON of the ``tokenizers`` library,
byte-level BPE). Its path is opened where it is installed on each machine; it
is never copied. The library itself is used by the tests only.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import chunks, flat, span_hashes
from tessera.llm.scratch import map_batches, schema_with

#: Fixed value: the word pattern of byte-level BPE vocabularies.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words remembered by a worker between chunks, and pairs judged; beyond it the memory is emptied, not the work.
MEMORY_WORDS = 400_000
MEMORY_PAIRS = 1_000_000


def default_vocabulary() -> str:
    """Place of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable
    Latin-1 stands for itself, the rest count up from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class KeyTable:
    """Immutable map from non-negative int64 keys to int32 values, looked up by
    whole arrays (open addressing, a probe per array operation); -1 if absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, dtype=np.int64)
        self._values = np.full(1 << bits, -1, dtype=np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self._keys[at] == -1
            slots, who = np.unique(at[free], return_index=True)
            placed = left[free][who]
            self._keys[slots], self._values[slots] = keys[placed], values[placed]
            done = self._keys[at] == keys[left]
            left, at = left[~done], (at[~done] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        there = self._keys[at]
        out = np.where(there == keys, self._values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) & self._mask
            there = self._keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self._values[at[left[hit]]]
            left = left[~hit & (there != -1)]
        return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(start, start + length)``."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(length)
    return np.arange(total) - np.repeat(ends - length, length) + np.repeat(start, length)


class Vocabulary:
    """Tables of one byte-level BPE vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in enumerate(byte_letters())}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*ids.values(), *self.special.values()]) + 1
        body: list[bytes] = [b""] * n
        for token, i in ids.items():
            body[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            body[i] = token.encode()
        self.n = n
        self.bytes = np.frombuffer(b"".join(body), dtype=np.uint8)
        self.length = np.fromiter(map(len, body), dtype=np.int64, count=n)
        self.start = np.cumsum(self.length) - self.length
        self.of_byte = np.zeros(256, dtype=np.int32)
        for c, b in letters.items():
            self.of_byte[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.fromiter((ids[a] for a, _ in pairs), dtype=np.int64, count=len(pairs))
        right = np.fromiter((ids[b] for _, b in pairs), dtype=np.int64, count=len(pairs))
        self.merged = np.fromiter((ids[a + b] for a, b in pairs), dtype=np.int32, count=len(pairs))
        self.rank = KeyTable(left * n + right, np.arange(len(pairs), dtype=np.int32))
        nodes: dict[tuple[int, int], int] = {}
        token_at = [-1]
        for token, i in ids.items():
            node = 0
            for c in token:
                node = nodes.setdefault((node, letters[c]), len(nodes) + 1)
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = i
        self.trie = KeyTable(np.fromiter((a * 256 + b for a, b in nodes), dtype=np.int64, count=len(nodes)), np.fromiter(nodes.values(), dtype=np.int32, count=len(nodes)))
        self.token_at = np.array(token_at, dtype=np.int32)
        single = np.flatnonzero(self.length > 0)
        out, first = self.merge(self.bytes[_ranges(self.start[single], self.length[single])], np.concatenate([[0], np.cumsum(self.length[single])]))
        self.built = np.zeros(n, dtype=bool)
        self.built[single] = (np.diff(first) == 1) & (out[np.minimum(first[:-1], len(out) - 1)] == single)

    def merge(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words: in each round every word replaces all
        places of its lowest-ranked pair, left to right."""
        tokens = self.of_byte[body].astype(np.int64)
        lengths = np.diff(at)
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_tokens, done_words = [], []
        while len(tokens):
            rank = np.full(len(tokens), 1 << 30, dtype=np.int64)
            if len(tokens) > 1:
                got = self.rank.get(tokens[:-1] * self.n + tokens[1:]).astype(np.int64)
                rank[:-1] = np.where((got >= 0) & (word[:-1] == word[1:]), got, 1 << 30)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            over = best == 1 << 30
            if over.any():
                done_tokens.append(tokens[over])
                done_words.append(word[over])
                keep = ~over
                tokens, word, rank, best = tokens[keep], word[keep], rank[keep], best[keep]
                if not len(tokens):
                    break
            take = rank == best
            # in a run of equal neighbours (aaa) only every second place merges, from the left
            run = np.arange(len(take)) - np.maximum.accumulate(np.where(take, -1, np.arange(len(take))))
            take &= (run & 1) == 1
            where = np.flatnonzero(take)
            tokens[where] = self.merged[rank[where]]
            stay = np.ones(len(tokens), dtype=bool)
            stay[where + 1] = False
            tokens, word = tokens[stay], word[stay]
        if not done_words:
            return np.zeros(0, dtype=np.int32), np.zeros(len(lengths) + 1, dtype=np.int64)
        words = np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        out = np.concatenate(done_tokens)[order].astype(np.int32)
        return out, np.searchsorted(words[order], np.arange(len(lengths) + 1))

    def greedy(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match cutting of many words, all trie walks in step."""
        n = len(at) - 1
        pos, end = at[:-1].copy(), at[1:]
        live = np.flatnonzero(pos < end)
        tokens, words = [], []
        while len(live):
            node = np.zeros(len(live), dtype=np.int64)
            here = pos[live].copy()
            best = np.full(len(live), -1, dtype=np.int64)
            best_end = here.copy()
            walk = np.arange(len(live))
            while len(walk):
                step = self.trie.get(node[walk] * 256 + body[here[walk]])
                walk, step = walk[step >= 0], step[step >= 0]
                node[walk] = step
                here[walk] += 1
                token = self.token_at[step]
                hit = token >= 0
                best[walk[hit]], best_end[walk[hit]] = token[hit], here[walk[hit]]
                walk = walk[here[walk] < end[live[walk]]]
            tokens.append(best)
            words.append(live)
            pos[live] = best_end
            live = live[best_end < end[live]]
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(n + 1, dtype=np.int64)
        word = np.concatenate(words)
        order = np.argsort(word, kind="stable")  # rounds are in order, so a stable sort keeps each word's tokens in order
        return np.concatenate(tokens)[order].astype(np.int32), np.searchsorted(word[order], np.arange(n + 1))


def _classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, every))
    out = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[every[m.start()] : every[m.end() - 1] + 1] = kind
    return out


class Pieces:
    """Cuts texts into the words of :data:`WORD_PATTERN`, all texts of a chunk at once.

    Runs of one character class are the words, with three rules on top: the
    last white space before a run is left over by the run of white space, and
    joins the word if it is a space; an apostrophe that starts a word takes
    the letters of a contraction with it; white space at the end stays whole.
    """

    #: Letters that an apostrophe takes with it.
    ONE, TWO = "stmd", ("re", "ve", "ll")

    def __init__(self) -> None:
        self.kind = _classes()

    def cut(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Start positions of the words in ``points``; ``ends``: where each text ends."""
        n = len(points)
        kind = self.kind[points]
        new = np.ones(n + 1, dtype=bool)
        new[1:n] = kind[1:] != kind[:-1]
        new[ends] = True
        last = np.zeros(n + 1, dtype=bool)
        last[ends] = True
        start = new[:n].copy()
        runs = np.flatnonzero(new[:n])
        stop = np.append(runs[1:], n)
        inner = (kind[runs] == 3) & ~last[stop]
        tail = stop[inner] - 1
        start[tail] = True
        start[stop[inner][points[tail] == 32]] = False
        mark = runs[(points[runs] == 39) & (stop - runs == 1) & ~last[stop]]
        mark = mark[start[mark]]
        mark = mark[kind[mark + 1] == 1]
        if len(mark):
            run_end = stop[np.searchsorted(runs, mark + 1)]
            one, two = points[mark + 1], points[np.minimum(mark + 2, n - 1)]
            size = np.isin(one, [ord(c) for c in self.ONE]).astype(np.int64)
            for x, y in self.TWO:
                size[(one == ord(x)) & (two == ord(y)) & (run_end - mark > 2)] = 2
            mark, size, run_end = mark[size > 0], size[size > 0], run_end[size > 0]
            start[mark + 1] = False
            rest = mark + 1 + size
            start[rest[rest < run_end]] = True
        return np.flatnonzero(start)


class Coder:
    """Encoder with the worker's memory of words and of judged pairs."""

    def __init__(self, path: str) -> None:
        self.vocab = Vocabulary(path)
        self.pieces = Pieces()
        self.entries = [self.vocab.bytes[a : a + n].tobytes() for a, n in zip(self.vocab.start.tolist(), self.vocab.length.tolist(), strict=True)]
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.vocab.special)) + ")").split if self.vocab.special else None
        self.speculated = self.repaired = 0
        self._pair = np.zeros(0, dtype=np.int64)
        self._good = np.zeros(0, dtype=bool)
        self._forget()

    def _forget(self) -> None:
        self._word = np.zeros(0, dtype=np.uint64)  # sorted hashes, and the place of each one's tokens
        self._place = np.zeros(0, dtype=np.int64)
        self._tokens = np.arange(self.vocab.n, dtype=np.int32)  # special tokens stand for themselves
        self._at = np.arange(self.vocab.n + 1, dtype=np.int64)
        self._points = np.zeros(0, dtype=np.uint32)  # code points of the words, to compare with
        self._points_at = np.zeros(self.vocab.n + 1, dtype=np.int64)

    def _judge(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the merges leave each pair ``a * n + b`` as it is."""
        v = self.vocab
        fresh = np.setdiff1d(pairs, self._pair)
        if len(fresh):
            a, b = fresh // v.n, fresh % v.n
            size = v.length[a] + v.length[b]
            body = v.bytes[_ranges(np.stack([v.start[a], v.start[b]], 1).ravel(), np.stack([v.length[a], v.length[b]], 1).ravel())]
            out, first = v.merge(body, np.concatenate([[0], np.cumsum(size)]))
            good = np.diff(first) == 2
            good[good] = (out[first[:-1][good]] == a[good]) & (out[first[:-1][good] + 1] == b[good])
            if len(self._pair) > MEMORY_PAIRS:
                known = np.searchsorted(self._pair, np.setdiff1d(pairs, fresh))
                self._pair, self._good = self._pair[known], self._good[known]
            at = np.searchsorted(self._pair, fresh)
            self._pair, self._good = np.insert(self._pair, at, fresh), np.insert(self._good, at, good)
        return self._good[np.searchsorted(self._pair, pairs)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of distinct words, end to end, and where each word starts."""
        v = self.vocab
        raw = [w.encode() for w in words]
        body = np.frombuffer(b"".join(raw), dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))])
        tokens, first = v.greedy(body, at)
        word = np.repeat(np.arange(len(words)), np.diff(first))
        bad = np.zeros(len(words), dtype=bool)
        bad[word[~v.built[tokens]]] = True
        inner = np.flatnonzero(word[:-1] == word[1:])
        if len(inner):
            pairs, back = np.unique(tokens[inner].astype(np.int64) * v.n + tokens[inner + 1], return_inverse=True)
            bad[word[inner[~self._judge(pairs)[back]]]] = True
        failing = np.flatnonzero(bad)
        self.speculated += len(words)
        self.repaired += len(failing)
        if not len(failing):
            return tokens, first
        fixed, fixed_first = v.merge(body[_ranges(at[failing], at[failing + 1] - at[failing])], np.concatenate([[0], np.cumsum(at[failing + 1] - at[failing])]))
        count, start = np.diff(first), first[:-1].copy()
        count[failing] = np.diff(fixed_first)
        start[failing] = len(tokens) + fixed_first[:-1]
        both = np.concatenate([tokens, fixed])
        return both[_ranges(start, count)], np.concatenate([[0], np.cumsum(count)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, end to end, and where each text starts."""
        special = self.vocab.special
        if self.split and any(s in text for s in special for text in texts):
            parts = [self.split(text) for text in texts]
        else:
            parts = [[text] for text in texts]
        flat_parts = [p for row in parts for p in row]
        whole = "".join(flat_parts)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum(np.fromiter(map(len, flat_parts), dtype=np.int64, count=len(flat_parts)))
        if not len(points):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        start = self.pieces.cut(points, ends)
        fixed: dict[int, int] = {}
        if len(flat_parts) > len(texts):  # the special tokens are single pieces
            keep = np.ones(len(start), dtype=bool)
            for part, end in zip(flat_parts, ends.tolist(), strict=True):
                if part in special:
                    a, b = np.searchsorted(start, [end - len(part), end])
                    keep[a + 1 : b] = False
                    fixed[end - len(part)] = special[part]
            start = start[keep]
        stop = np.append(start[1:], len(points))
        words, one, back = np.unique(span_hashes(points, start, stop), return_index=True, return_inverse=True)
        at = np.searchsorted(self._word, words)
        known = at < len(self._word)
        known[known] = self._word[at[known]] == words[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            if len(self._word) + len(fresh) > MEMORY_WORDS:
                self._forget()
                fresh = np.arange(len(words))
            a, b = start[one[fresh]].tolist(), stop[one[fresh]].tolist()
            tokens, first = self.encode_words([whole[x:y] for x, y in zip(a, b, strict=True)])
            place = len(self._at) - 1 + np.arange(len(fresh))
            self._at = np.concatenate([self._at, first[1:] + len(self._tokens)])
            self._tokens = np.concatenate([self._tokens, tokens])
            size = stop[one[fresh]] - start[one[fresh]]
            self._points_at = np.concatenate([self._points_at, np.cumsum(size) + len(self._points)])
            self._points = np.concatenate([self._points, points[_ranges(start[one[fresh]], size)]])
            at = np.searchsorted(self._word, words[fresh])
            self._word, self._place = np.insert(self._word, at, words[fresh]), np.insert(self._place, at, place)
        place = self._place[np.searchsorted(self._word, words)][back]
        if not self._same(place, points, start, stop):
            place = self._apart(whole, start, stop)
        for p, i in fixed.items():
            place[np.searchsorted(start, p)] = i
        count = self._at[place + 1] - self._at[place]
        ids = self._tokens[_ranges(self._at[place], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        text_end = ends[np.cumsum([len(row) for row in parts]) - 1]
        return ids, np.concatenate([[0], total[np.searchsorted(start, text_end)]])

    def _same(self, place: np.ndarray, points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> bool:
        """Whether every word is the remembered one that its hash found, by its code points."""
        first = self._points_at[place]
        size = stop - start
        return bool((self._points_at[place + 1] - first == size).all()) and np.array_equal(points[start[0] :], self._points[_ranges(first, size)])

    def _apart(self, whole: str, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Places of all words when two different ones share a hash: told apart by their text, remembered by none."""
        texts = [whole[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        number = {w: k for k, w in enumerate(dict.fromkeys(texts))}
        self._forget()
        tokens, first = self.encode_words(list(number))
        self._at = np.concatenate([self._at, first[1:] + len(self._tokens)])
        self._tokens = np.concatenate([self._tokens, tokens])
        self._points_at = np.concatenate([self._points_at, np.zeros(len(number), dtype=np.int64)])
        return self.vocab.n + np.fromiter((number[w] for w in texts), dtype=np.int64, count=len(texts))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of the decoded texts (broken sequences become U+FFFD)."""
        entry, own, cut = self.entries.__getitem__, ids.tolist(), first.tolist()
        return [b"".join(map(entry, own[a:b])).decode("utf-8", "replace").encode() for a, b in zip(cut, cut[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One coder per worker process and vocabulary."""
    return Coder(path)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pack: bool = False) -> DataFrame:
    """``id_col, ids, decoded binary`` of every whole text.

    ``ids`` are the vocabulary ids (special-token strings in a text become their
    special id): ``array<int>``, or with ``pack`` their little-endian unsigned
    32-bit form as ``binary``, the compact form for storage. ``decoded`` are the
    UTF-8 bytes of decoding them again. A row per input row, repeated rows and
    null ids included; null text counts as empty (no ids, empty bytes). Other
    input columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            body, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                raw = body[offsets[i] : offsets[j]].tobytes()
                cut = (offsets[i : j + 1] - offsets[i]).tolist()
                ids, first = own.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)])
                decoded = pa.array(own.decode(ids, first), pa.binary())
                if pack:
                    column = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                else:
                    column = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), column, decoded], names=["id", "ids", "decoded"])

    schema = schema_with(docs.schema[id_col].dataType, f"ids {'binary' if pack else 'array<int>'}, decoded binary")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)
