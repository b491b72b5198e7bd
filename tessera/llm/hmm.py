"""Hidden Markov language model, trained by Baum-Welch across partitions.

A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and an end token.
Every word belongs to one of ``CLASSES`` classes by its hash; the end is a
class of its own. Hidden states follow each other by a transition matrix and
emit classes; within its class a word has the add-one share of its count in
the training texts, with one place per class for words never seen:

    P(word | state) = emit[state, class] * (c + 1) / (C_class + V_class + 1)

So the parameters that Baum-Welch learns are bounded (states x classes, sent to
every task), while the word counts, which grow with the corpus, are a table that
is joined and never collected.

*Tokens* are written once, a row per block of about ``BLOCK_BYTES`` of text: the
block's distinct word hashes, the most frequent first, and every token as a
place among them, compressed. Training passes and scoring read that table.

*Training*: every task runs forward and backward over whole texts, those of a block in
step. Forward values are kept every ``SEGMENT`` steps only; going back, each piece is
computed again from those before it, so memory is bounded by a piece whatever the length
of a text, and the values of both directions cross all pieces. Expected counts per class
are aggregated, the driver gets states x classes numbers. Rounds end after ``ROUNDS``, or
when the likelihood of a training token grows by less than ``LEAST_GAIN`` (its logarithm).

*Scoring*: the scaled forward recursion over whole texts gives the exact
likelihood of the class sequence; word shares come from a join of the blocks'
distinct words with the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytescan import BLACK, Words, chunks, flat, mix
from tessera.llm.scratch import map_batches, store

STATES = 8
CLASS_BITS = 14
CLASSES = 1 << CLASS_BITS  # the end is class number CLASSES
ROUNDS = 3
LEAST_GAIN = 0.002
#: Steps of time between kept forward values.
SEGMENT = 128
BLOCK_BYTES = 8 << 20
#: Documents that seed the states' first emissions, and the longest that is taken.
SEED_DOCS, SEED_BYTES = 256, 1 << 16
#: Weight, in tokens, of the class shares of the whole corpus in every state's emissions.
PRIOR = 50.0

END = np.uint64(0xFFFFFFFFFFFFFFFF)  # above every word hash (the scan never yields it)


def class_of(hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == END, CLASSES, (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64))


@dataclass
class Hmm:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (CLASSES + 1, states)
    #: Mean log likelihood of a training token under the model that this one was learned from.
    likelihood: float = float("nan")


def in_step(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that runs sequences in step: token places by time, then longest
    sequence first; the rank of each place's sequence; and where each time starts.
    ``first``: where each (non-empty) sequence starts, one more entry than sequences."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max())
    active = np.searchsorted(-size[order], -np.arange(longest), side="left")  # sequences longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    time = np.repeat(np.arange(longest), active)
    rank = np.arange(at[-1]) - at[time]
    return first[:-1][order][rank] + time, order[rank], at


def forward(model: Hmm, classes: np.ndarray, at: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward recursion over some steps of time (``at``: where each starts in ``classes``),
    ``before`` holding the values of the step before them (none: the texts start here).
    Returns scaled values, scales, emissions."""
    seen = model.emit[classes]
    alpha, scale = np.empty_like(seen), np.empty(len(classes))
    for t in range(len(at) - 1):
        a, b = at[t], at[t + 1]
        last = before if t == 0 else alpha[at[t - 1] : a]
        value = seen[a:b] * (model.start if last is None else last[: b - a] @ model.move)
        total = value.sum(axis=1)
        scale[a:b] = total
        alpha[a:b] = value / total[:, None]
    return alpha, scale, seen


def expected_counts(model: Hmm, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions of whole sequences, and their log likelihood."""
    place, _, at = in_step(first)
    own, steps = classes[place], len(at) - 1
    pieces = [(p, min(p + SEGMENT, steps)) for p in range(0, steps, SEGMENT)]
    local = lambda p, q: (own[at[p] : at[q]], at[p : q + 1] - at[p])
    kept: list[np.ndarray | None] = [None]  # values of the step before each piece
    for p, q in pieces[:-1]:
        alpha, _, _ = forward(model, *local(p, q), kept[-1])
        kept.append(alpha[at[q - 1] - at[p] :].copy())
    moves, emits, likelihood = np.zeros_like(model.move), np.zeros_like(model.emit), 0.0
    after: np.ndarray | None = None  # emission, scale and backward value of the step behind a piece
    starts = np.zeros_like(model.start)
    for (p, q), before in zip(reversed(pieces), reversed(kept), strict=True):
        mine, cut = local(p, q)
        alpha, scale, seen = forward(model, mine, cut, before)
        likelihood += float(np.log(scale).sum())
        seen /= scale[:, None]
        beta = np.ones_like(alpha)
        for t in range(q - p - 1, -1, -1):
            a, b = cut[t], cut[t + 1]
            later = after
            if later is not None:
                beta[a : a + len(later)] = later @ model.move.T
                moves += alpha[a : a + len(later)].T @ later
            after = seen[a:b] * beta[a:b]
        alpha *= beta
        for s in range(alpha.shape[1]):
            emits[:, s] += np.bincount(mine, weights=alpha[:, s], minlength=len(emits))
        if p == 0:
            starts = alpha[: cut[1]].sum(axis=0)
    return starts, moves * model.move, emits, likelihood


def expected(model: Hmm, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions of some sequences."""
    return expected_counts(model, classes, first)[:3]


def _log10_forward(model: Hmm, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 likelihood of each (non-empty) class sequence; memory for one step of time at a time."""
    place, sequence, at = in_step(first)
    out = np.zeros(len(first) - 1)
    alpha = np.zeros((0, len(model.start)))
    for t in range(len(at) - 1):
        a, b = at[t], at[t + 1]
        value = model.emit[classes[place[a:b]]] * (alpha[: b - a] @ model.move if t else model.start)
        total = value.sum(axis=1)
        out[sequence[a:b]] += np.log10(total)
        alpha = value / total[:, None]
    return out


def packed_ints(values: np.ndarray) -> bytes:
    """32-bit integers by byte planes, compressed; small values take little room."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def unpacked_ints(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def tokenize(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """Written table of blocks: ``block, ids, held, sizes, hashes, places``.

    ``hashes``: the block's distinct tokens (64-bit, END among them); ``sizes``:
    tokens of each text, its end included; ``places``: one per token, packed.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("held", T.ArrayType(T.BooleanType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("hashes", T.BinaryType()),
            T.StructField("places", T.BinaryType()),
        ]
    )

    def row(number: int, parts: list[tuple]) -> pa.RecordBatch:
        tokens = np.concatenate([p[3] for p in parts])
        distinct, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        whole = [pa.concat_arrays([p[k] for p in parts]) for k in range(3)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([distinct[order].tobytes()], pa.binary()), pa.array([packed_ints(rank[back])], pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for batch in batches:
            body, offsets = flat(batch.column(2))
            for i, j in chunks(offsets):
                words = Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], BLACK)
                got = np.minimum(words.hashes(), END - np.uint64(1))
                tokens = np.full(len(got) + j - i, END, dtype=np.uint64)
                tokens[np.arange(len(got)) + words.doc] = got  # every text before has its end
                parts.append((batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(words.count + 1, pa.int32()), tokens))
                size += int(offsets[j] - offsets[i])
                if size >= BLOCK_BYTES:
                    yield row(number, parts)
                    number, parts, size = number + 1, [], 0
        if parts:
            yield row(number, parts)

    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).cast("binary").alias("text"))
    return store(map_batches(rows, run, schema), "tokens")


def _block(batch: pa.RecordBatch, k: int, *names: str) -> list[np.ndarray]:
    """Columns of block row ``k`` as arrays."""
    out = []
    for name in names:
        cell = batch.column(name)[k]
        if name == "hashes":
            out.append(np.frombuffer(cell.as_buffer(), dtype=np.uint64))
        elif name == "places":
            out.append(unpacked_ints(cell.as_py(), int(batch.column("sizes")[k].values.to_numpy().sum())))
        else:
            out.append(cell.values.to_numpy(zero_copy_only=False))
    return out


def word_counts(tokens: DataFrame) -> DataFrame:
    """Written ``h, c``: counts of all training tokens (ends too); grows with the vocabulary."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, back = np.unique(h, return_inverse=True)
        return keys, np.bincount(back, weights=n).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "c"])

        for batch in batches:
            for k in range(batch.num_rows):
                held, sizes, hashes, places = _block(batch, k, "held", "sizes", "hashes", "places")
                n = np.bincount(places[np.repeat(~held.astype(bool), sizes)], minlength=len(hashes))
                parts.append((hashes[n > 0], n[n > 0]))
                size += len(parts[-1][0])
                if size > 2_000_000:  # what a task holds is bounded; the shuffle adds up the rest
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    rows = map_batches(tokens.select("held", "sizes", "hashes", "places"), run, "h long, c long")
    return store(rows.groupBy("h").agg(F.sum("c").alias("c")), "word-counts")


@dataclass
class ClassTotals:
    """Per class: tokens and distinct words in training; bounded by the number of classes."""

    tokens: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> ClassTotals:
        number = F.when(F.col("h") == int(END.view(np.int64)), F.lit(CLASSES)).otherwise(F.shiftrightunsigned("h", 64 - CLASS_BITS).cast("int"))
        rows = counts.groupBy(number.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
        out = cls(np.zeros(CLASSES + 1), np.zeros(CLASSES + 1))
        out.tokens[rows["k"]] = rows["c"]
        out.words[rows["k"]] = rows["v"]
        return out

    def shares(self) -> np.ndarray:
        return (self.tokens + 1) / (self.tokens + 1).sum()


def seeded(docs: DataFrame, id_col: str, text_col: str, held_out: Column, totals: ClassTotals, states: int = STATES) -> Hmm:
    """First model: every state starts from a document unlike those before it,
    chosen among ``SEED_DOCS`` training documents (smallest hash of id and text)."""
    size = F.octet_length(F.col(text_col).cast("binary"))
    rows = docs.where(~held_out & (size > 0) & (size <= SEED_BYTES)).select(F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"))
    # hashes first: every task offers its smallest ones, and texts would be too much for that
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(SEED_DOCS).collect()]
    texts = [bytes(r["text"]) for r in rows.where(F.col("h").isin(least)).dropDuplicates(["h"]).orderBy("h").collect()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words = Words(np.frombuffer(b"".join(texts), dtype=np.uint8), at, BLACK)
    own = class_of(words.hashes())
    share = totals.shares()
    emit = np.repeat(share[:, None], states, axis=1)
    if len(own):
        profile = np.zeros((len(texts), CLASSES + 1))
        np.add.at(profile, (words.doc, own), 1.0)
        # shared words tell nothing: weigh by rarity among the seeds, then compare directions
        weighed = np.sqrt(profile) * np.log1p(len(texts) / (1 + (profile > 0).sum(axis=0)))
        weighed /= np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12)
        chosen = [int(np.argmax(words.count))]
        while len(chosen) < min(states, len(texts)):
            chosen.append(int(np.argmin((weighed @ weighed[chosen].T).max(axis=1) - 1e-6 * np.minimum(words.count, 500))))
        for s, d in enumerate(chosen):
            near = np.argsort(-(weighed @ weighed[d]), kind="stable")[: max(1, len(texts) // (2 * states))]
            mean = profile[near].sum(axis=0)
            emit[:, s] = 0.3 * share + 0.7 * (mean + PRIOR * share) / (mean.sum() + PRIOR)
    emit *= 1 + 0.01 * (mix(np.arange(emit.size, dtype=np.uint64)).astype(np.float64) / 2**64).reshape(emit.shape)
    emit /= emit.sum(axis=0)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Hmm(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit)


def baum_welch(tokens: DataFrame, model: Hmm, totals: ClassTotals) -> Hmm:
    """One round over all training texts."""
    states = len(model.start)
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    names = [f"x{s}" for s in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Hmm = shared.value
        table = np.zeros((CLASSES + 3 + states, states))  # emissions, starts, moves, likelihood and tokens
        for batch in batches:
            for k in range(batch.num_rows):
                held, sizes, hashes, places = _block(batch, k, "held", "sizes", "hashes", "places")
                taught = ~held.astype(bool)
                classes = class_of(hashes)[places[np.repeat(taught, sizes)]]
                if len(classes):
                    starts, moves, emits, likelihood = expected_counts(own, classes, np.concatenate([[0], np.cumsum(sizes[taught], dtype=np.int64)]))
                    table[: CLASSES + 1] += emits
                    table[CLASSES + 1] += starts
                    table[CLASSES + 2 : -1] += moves
                    table[-1, 0] += likelihood
                    table[-1, -1] += len(classes)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(table[some, s]) for s in range(states)]], names=["k", *names])

    schema = "k int, " + ", ".join(f"{n} double" for n in names)
    rows = map_batches(tokens.select("held", "sizes", "hashes", "places"), run, schema).groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    table = np.zeros((CLASSES + 3 + states, states))
    table[rows["k"]] = rows[names]
    emit = table[: CLASSES + 1] + PRIOR * totals.shares()[:, None]
    start, move = table[CLASSES + 1] + 0.1, table[CLASSES + 2 : -1] + 0.1
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), float(table[-1, 0] / max(1.0, table[-1, -1])))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Trains on the rows where ``held_out`` is false and scores all. ``base_score``
    is the add-one unigram log10 probability, ``score`` the model's log10
    probability of the whole text. Null text counts as empty (its only token is
    the end). A row per input row (repeats and null ids included); other columns
    are ignored, whatever their names; an empty table gives an empty result.
    Without training rows every count is 0 and all states emit alike.
    """
    tokens = tokenize(docs, id_col, text_col, held_out)
    counts = word_counts(tokens)
    totals = ClassTotals.of(counts)
    model = seeded(docs, id_col, text_col, held_out, totals, states)
    for _ in range(rounds):
        before, model = model.likelihood, baum_welch(tokens, model, totals)
        if model.likelihood - before < LEAST_GAIN:  # not in the first round, which has nothing before it
            break

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (hashes,) = _block(batch, k, "hashes")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hashes), batch.column("block")[k].as_py()), pa.int64()), pa.array(np.arange(len(hashes)), pa.int32()), pa.array(hashes.view(np.int64))], names=["block", "place", "h"]
                )

    def by_place(part: pa.Table) -> pa.Table:
        c = part.column("c").to_numpy()[np.argsort(part.column("place").to_numpy())]
        return pa.table({"block": pa.array([part.column("block")[0].as_py()], pa.int64()), "counts": pa.array([c.astype(np.int64).tobytes()], pa.binary())})

    words = map_batches(tokens.select("block", "hashes"), distinct_words, "block long, place int, h long")
    known = words.join(counts, "h", "left").select("block", "place", F.coalesce("c", F.lit(0).cast("long")).alias("c"))
    blocks = known.groupBy("block").applyInArrow(by_place, "block long, counts binary")
    shared = docs.sparkSession.sparkContext.broadcast((model, totals))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = shared.value
        n, v = float(sums.tokens.sum()), float(sums.words.sum())
        whole = np.log10(n + v + 1)
        room = np.log10(sums.tokens + sums.words + 1)
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, hashes, places = _block(batch, k, "sizes", "hashes", "places")
                c = np.frombuffer(batch.column("counts")[k].as_buffer(), dtype=np.int64)
                first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                classes = class_of(hashes)
                share = np.where(hashes == END, 0.0, np.log10(c + 1) - room[classes])
                per_text = lambda x: np.add.reduceat(x[places], first[:-1])  # noqa: E731  every text has its end, so none is empty
                counted = per_text(np.log10(c + 1)) - sizes * whole
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[k].values,
                        batch.column("held")[k].values,
                        pa.array(sizes, pa.int64()),
                        pa.array(per_text((c > 0).astype(np.int64)), pa.int64()),
                        pa.array(np.full(len(sizes), int(n)), pa.int64()),
                        pa.array(counted, pa.float64()),
                        pa.array(_log10_forward(own, classes[places], first) + per_text(share), pa.float64()),
                    ],
                    names=schema.names,
                )

    return map_batches(tokens.join(blocks, "block").select("ids", "held", "sizes", "hashes", "places", "counts"), run, schema).withColumnRenamed("id", id_col)
