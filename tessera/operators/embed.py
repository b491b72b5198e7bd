"""Text embedding as a Spark job (the model plug-in surface).

An embedder is any object with ``dim`` and ``encode(texts) -> ndarray``. It
runs inside an iterator Pandas UDF: one instance per Python worker, Arrow
batches in, ``array<double>`` out, no shuffle.

``HashingEmbedder`` is the built-in, model-free stand-in: lower-case tokens
(runs of characters other than ASCII non-alphanumerics), each counted into
bucket ``int(md5(token)[:8], 16) % dim``. It is deterministic and can be
re-derived in plain SQL, which is what the oracle does. It carries no
semantic quality; a sentence-embedding model plugs into the same slot
(``SentenceTransformerEmbedder``, used only if the library is installed).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import HASH_DIM
from ..functions.text import TOKEN_PATTERN

_TOKEN_RE = re.compile(TOKEN_PATTERN)
#: Characters whose tokens are held at once, and buckets that are remembered (the words met first, so the frequent ones).
SLICE_CHARS = 1 << 20
CACHED_TOKENS = 200_000


def text_slices(texts: Sequence[str | None]) -> Iterator[slice]:
    """Runs of texts of about ``SLICE_CHARS`` characters together (a longer text is one of its own)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t) if t else 0
        if i > start and held + size > SLICE_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


class HashingEmbedder:
    """Term counts of md5-hashed tokens (unsigned, so similarities are >= 0)."""

    def __init__(self, dim: int = HASH_DIM):
        self.dim = dim
        self._bucket_cache: dict[str, int] = {}

    def _bucket(self, tok: str) -> int:
        b = self._bucket_cache.get(tok)
        if b is None:
            b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % self.dim
            if len(self._bucket_cache) < CACHED_TOKENS:
                self._bucket_cache[tok] = b
        return b

    def encode(self, texts: Sequence[str | None]) -> np.ndarray:
        """Vectors of the texts, a slice of them at a time: what is held does not grow with the batch."""
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for part in text_slices(texts):
            out[part] = self._encode(texts[part])
        return out

    def _encode(self, texts: Sequence[str | None]) -> np.ndarray:
        """Vectorised per slice: tokens are factorised once, only distinct
        tokens are hashed, and all counts come from one ``bincount``."""
        n = len(texts)
        per_doc = [_TOKEN_RE.findall(t.lower()) if t else [] for t in texts]
        lengths = np.fromiter((len(x) for x in per_doc), dtype=np.int64, count=n)
        total = int(lengths.sum())
        if total == 0:
            return np.zeros((n, self.dim), dtype=np.float64)
        flat = np.empty(total, dtype=object)
        flat[:] = [tok for doc in per_doc for tok in doc]
        codes, uniques = pd.factorize(flat)
        ub = np.fromiter((self._bucket(u) for u in uniques), dtype=np.int64, count=len(uniques))
        doc = np.repeat(np.arange(n, dtype=np.int64), lengths)
        counts = np.bincount(doc * self.dim + ub[codes], minlength=n * self.dim)
        return counts.reshape(n, self.dim).astype(np.float64)


class SentenceTransformerEmbedder:
    """Optional plug-in around a sentence-transformers model (not installed here)."""

    def __init__(self, model_name: str = "paraphrase-multilingual-mpnet-base-v2", batch_size: int = 64):
        self.model_name = model_name
        self.batch_size = batch_size
        self._model = None
        self.dim = None

    def encode(self, texts: Sequence[str | None]) -> np.ndarray:
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer  # type: ignore
            except ImportError as e:  # pragma: no cover - optional dependency
                raise RuntimeError("sentence-transformers is not installed") from e
            self._model = SentenceTransformer(self.model_name)
            self.dim = self._model.get_sentence_embedding_dimension()
        return np.asarray(
            self._model.encode([t or "" for t in texts], batch_size=self.batch_size, convert_to_numpy=True),
            dtype=np.float64,
        )


def l2_normalize_rows(m: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """``v / max(||v||, eps)`` per row (what ``normalize_embeddings=True`` does)."""
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.maximum(norms, eps)


class BudgetedEmbedder:
    """An embedder that sees its texts in batches of like length under a token budget.

    A batch is padded to its longest text, so it costs (texts x longest); texts are sorted by
    length and a batch is filled while that stays within ``budget`` (a longer text is
    a batch of its own). Vectors come back in the order of the texts. ``tokens`` counts a
    text's tokens (white-space words by default; a model gives its tokenizer's count).
    """

    def __init__(self, embedder, budget: int, tokens=None) -> None:
        self.embedder, self.budget, self._tokens = embedder, budget, tokens or (lambda t: len((t or "").split()))

    @property
    def dim(self):
        return self.embedder.dim

    def encode(self, texts: Sequence[str | None]) -> np.ndarray:
        size = np.array([max(1, self._tokens(t)) for t in texts], dtype=np.int64)
        order = np.argsort(size, kind="stable")
        out, at = None, 0
        while at < len(order):
            # lengths ascend, so the cost of a batch ending at j is (j - at + 1) * size[j]
            cost = size[order[at:]] * np.arange(1, len(order) - at + 1)
            end = at + max(1, int(np.searchsorted(cost, self.budget, side="right")))
            part = order[at:end]
            got = np.asarray(self.embedder.encode([texts[i] for i in part]))
            if out is None:
                out = np.empty((len(texts), got.shape[1]), dtype=got.dtype)
            out[part], at = got, end
        return out if out is not None else np.asarray(self.embedder.encode([]))


def embed_column(text: Column | str, embedder=None, normalize: bool = False) -> Column:
    """Column expression: embedding of ``text`` as ``array<double>``."""
    emb = embedder or HashingEmbedder()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            m = emb.encode(s.tolist())
            if normalize:
                m = l2_normalize_rows(m)
            yield pd.Series(list(m))

    # Marked non-deterministic only so the optimizer never copies the call into
    # a pushed-down predicate (e.g. the not-null/size filter Spark infers for
    # explode), which would run inference twice.
    return _embed.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def embed_texts(
    df: DataFrame, text_col: str, out_col: str = "embedding", embedder=None, normalize: bool = False
) -> DataFrame:
    """Append ``out_col`` = embedding of ``text_col`` (one Arrow-batched pass)."""
    return df.withColumn(out_col, embed_column(text_col, embedder, normalize))


def sparse_entries(df: DataFrame, key_cols: Sequence[str], vec_col: str, value_name: str = "weight") -> DataFrame:
    """Long form ``(keys..., dim, weight)`` of the non-zero vector entries."""
    return (
        df.select(*key_cols, F.posexplode_outer(vec_col).alias("dim", value_name))
        .where(F.col(value_name) != 0)
        .withColumn("dim", F.col("dim").cast("bigint"))
    )
