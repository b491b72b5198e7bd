"""Language identification by prediction by partial matching.

Per language a variable-order byte context tree is counted: how often each
byte followed each context of up to ``ORDER`` bytes. Frozen after training, it
assigns every byte of a text a probability: a byte seen in the longest known
context gets ``count / (total + distinct)``; an unseen one pays the escape
``distinct / (total + distinct)`` and is looked up in the next shorter
context, down to the uniform 1/256. The sum of ``-log2`` over the whole text is
the exact length of its code; the language with the shortest code wins.

Every language has its own tree, whole: a sorted array of the grams (context and
byte) it saw, with the cost of the byte after the context and of an escape from
the gram as a context. Trees are counted by Spark and sent in blocks of about
``BLOCK_GRAMS`` grams (a language is never split); a worker looks up the distinct
grams of a chunk of texts, block by block. Neither contexts nor languages are
capped.

Training is a fit on a bounded sample: at most ``SAMPLE_DOCS`` documents per
language, those with the smallest hash of id and text. Everything else covers
all documents and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bytescan import chunks, flat
from tessera.llm.scratch import BROADCAST_KEYS, map_batches, packed, schema_with, store, unpacked

ORDER = 3
#: Bound of the fit: documents per language, and bytes of the longest that is taken.
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 1 << 20
#: Grams of one broadcast (16 bytes each), unless a single language has more.
BLOCK_GRAMS = 1 << 21
#: Contexts that a language saw less often are left to shorter ones; 1 keeps all.
MIN_CONTEXT = 1
UNKNOWN = "und"


_LOW = np.uint64((1 << 32) - 1)


def _of_size(size: int, grams: np.ndarray) -> np.ndarray:
    """Keys of the newest ``size`` bytes of ``grams``: the size above 32 bits of gram."""
    return (grams & np.uint64((1 << 8 * size) - 1)) | np.uint64(size << 32)


def _text_grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Key of the up to ``ORDER`` bytes before each byte, inside its text, and the byte."""
    n = len(data)
    left = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    gram = np.zeros(n, dtype=np.uint64)
    for back in range(ORDER + 1):
        gram[back:] |= np.where(left[back:] >= back, data[: max(n - back, 0)].astype(np.uint64) << np.uint64(8 * back), np.uint64(0))
    return gram | ((np.minimum(left, ORDER) + 1).astype(np.uint64) << np.uint64(32))


@dataclass
class PpmTree:
    """Frozen statistics of one language."""

    keys: np.ndarray  # sorted grams
    cost: np.ndarray  # bits of the newest byte after the others
    escape: np.ndarray  # bits of "none of its successors" after the gram; 0 if it is no context
    root: float  # the same after no byte

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray) -> PpmTree:
        """From sorted distinct ``keys`` and how often each was seen."""
        context = np.where(keys >> np.uint64(32) > 1, ((keys & _LOW) >> np.uint64(8)) | (((keys >> np.uint64(32)) - np.uint64(1)) << np.uint64(32)), np.uint64(0))
        contexts, where = np.unique(context, return_inverse=True)
        total, distinct = np.bincount(where, weights=n), np.bincount(where)
        known = (total >= MIN_CONTEXT) | (contexts == 0)
        bits = np.log2(total + distinct)
        out = np.where(known, bits - np.log2(distinct), 0.0)
        at = np.minimum(np.searchsorted(contexts, keys), len(contexts) - 1)
        escape = np.where(contexts[at] == keys, out[at], 0.0)
        cost = np.where(known[where], bits[where] - np.log2(n), np.inf)  # infinite: the context is not kept
        return cls(keys, cost.astype(np.float32), escape.astype(np.float32), float(out[0]))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the newest byte of each gram, through all escapes."""
        size, gram = keys >> np.uint64(32), keys & _LOW
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            deep = size[left] > order
            now = left[deep]
            at, hit = self.find(_of_size(order + 1, gram[now]))
            hit &= np.isfinite(self.cost[at])
            out[now[hit]] += self.cost[at[hit]]
            missed = now[~hit]
            if order:
                at, hit = self.find(_of_size(order, gram[missed] >> np.uint64(8)))
                out[missed[hit]] += self.escape[at[hit]]
            else:
                out[missed] += self.root
            left = np.concatenate([left[~deep], missed])
        out[left] += 8
        return out


@dataclass
class PpmModel:
    """``languages`` in order and their trees, in broadcast blocks in the same order."""

    languages: list[str]
    blocks: list[Broadcast]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language, (texts, languages)."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data) or not self.languages:
            return out
        keys, where = np.unique(_text_grams(data, offsets), return_inverse=True)
        full = np.flatnonzero(np.diff(offsets) > 0)
        starts = offsets[:-1][full]
        j = 0
        for block in self.blocks:
            for tree in block.value:
                out[full, j] = np.add.reduceat(tree.costs(keys)[where], starts)
                j += 1
            if len(self.blocks) > 1 and hasattr(block, "_path"):
                vars(block).pop("_value", None)  # one block at a time; read again for the next chunk
        return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """``lang, text binary``: the bounded training sample, the same rows on every run.

    Languages are counted first; a hash threshold then leaves about 1.3 times
    the wanted rows (never a whole language in one task), of which the smallest
    hashes are taken.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)
    )
    counts = store(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    few = counts.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    near = rows.join(F.broadcast(counts) if few else counts, "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.least(F.lit(1.0), F.lit(1.3 * per_language + 50) / F.col("rows")))
    return near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= per_language).select("lang", "text")


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, key, n``: runs of 1 to ORDER + 1 bytes (oldest byte highest)."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        body, offsets = flat(batch.column(1))
        for lang in sorted(set(langs.tolist())):
            mine = np.flatnonzero(langs == lang)
            part = np.concatenate([body[offsets[i] : offsets[i + 1]] for i in mine]).astype(np.uint64)
            left = np.concatenate([np.arange(offsets[i + 1] - offsets[i]) for i in mine])  # bytes before, inside the text
            gram = np.zeros(len(part), dtype=np.uint64)
            for size in range(1, ORDER + 2):
                back = size - 1
                gram[back:] |= part[: len(part) - back] << np.uint64(8 * back)
                keys, n = np.unique(gram[left >= back], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(_of_size(size, keys).astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "key", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS) -> PpmModel:
    """Model from the labelled rows of ``docs``. Null languages and null texts
    teach nothing; without any labelled row the model knows no language."""
    taught = map_batches(sample(docs, id_col, text_col, lang_col, per_language), _gram_counts, "lang string, key long, n long")
    grams = store(taught.groupBy("lang", "key").agg(F.sum("n").alias("n")), "grams")
    sizes = sorted((r["lang"], r["grams"]) for r in grams.groupBy("lang").agg(F.count("*").alias("grams")).collect())
    groups: list[list[str]] = []
    room = 0
    for lang, size in sizes:
        if size > room:
            groups.append([])
            room = BLOCK_GRAMS
        groups[-1].append(lang)
        room -= size
    blocks = []
    for group in groups:  # one block on the driver at a time; languages are sorted as Spark sorts them
        got = grams.where(F.col("lang").between(group[0], group[-1])).toArrow()
        own = pc.index_in(got["lang"], pa.array(group, pa.string())).to_numpy()
        keys, n = got["key"].to_numpy().astype(np.uint64), got["n"].to_numpy()
        order = np.lexsort((keys, own))
        cuts = np.searchsorted(own[order], np.arange(len(group) + 1))
        trees = [PpmTree.of(keys[order[a:b]], n[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        blocks.append(docs.sparkSession.sparkContext.broadcast(trees))
    return PpmModel([lang for lang, _ in sizes], blocks)


def score(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text binary, lang_pred, score, bits_per_byte`` of every whole text.

    ``score`` is the posterior of the predicted language (equal priors) from
    the exact code lengths, ``bits_per_byte`` the winner's code length per
    byte. Null text or text without a letter: ``und``, score 0, no bits. Ties
    go to the alphabetically first language. A row per input row (repeats and
    null ids included); other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    schema = schema_with(docs.schema[id_col].dataType, "text binary, lang_pred string, score double, bits_per_byte double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model
        for batch in batches:
            body, offsets = flat(batch.column(1))
            for i, j in chunks(offsets, 1 << 19):
                at = offsets[i : j + 1] - offsets[i]
                data = body[offsets[i] : offsets[j]]
                bits = own.bits(data, at)
                raw = data.tobytes()
                letter = [any(map(str.isalpha, raw[a:b].decode("utf-8", "replace"))) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                good = np.array(letter, dtype=bool) & bool(own.languages)
                if own.languages:
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(bits)), best]
                    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    names = np.array(own.languages, dtype=object)[best]
                else:
                    least = share = np.zeros(j - i)
                    names = np.full(j - i, UNKNOWN, dtype=object)
                size = np.maximum(np.diff(at), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(np.where(good, names, UNKNOWN), pa.string()),
                        pa.array(np.where(good, share, 0.0), pa.float64()),
                        pa.array(least / size, pa.float64(), mask=~good),
                    ],
                    names=["id", "text", "lang_pred", "score", "bits_per_byte"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)


def crc_bucket(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id is in bucket 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n)), F.lit(0))


def keep_known(docs: DataFrame, model: PpmModel, text_col: str = "text", max_bits: float | None = None) -> DataFrame:
    """``docs`` without what no learned language explains: ``und``, or more than
    ``max_bits`` bits per byte. Rows are judged one by one; all columns stay."""
    judged = score(packed(docs, text_col), model, "row", text_col)
    if text_col != "text":
        judged = judged.withColumnRenamed("text", text_col)
    keep = F.col("lang_pred") != UNKNOWN
    if max_bits is not None:
        keep &= F.col("bits_per_byte") <= max_bits
    return unpacked(judged.where(keep), docs.columns, text_col)
