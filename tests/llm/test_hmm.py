import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import hmm
from tessera.llm.langid import crc_bucket
from tests.llm.helpers import ODD, black_words, odd_documents, with_clashing_columns

DOCS = "/root/testdata/sf0.01/documents.parquet"


def small_model(states=3, seed=1):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Hmm(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((hmm.CLASSES + 1, states)), 0))


def paths(model, classes):
    """Every state path and its probability."""
    for path in itertools.product(range(len(model.start)), repeat=len(classes)):
        p = model.start[path[0]] * model.emit[classes[0], path[0]]
        for t in range(1, len(classes)):
            p *= model.move[path[t - 1], path[t]] * model.emit[classes[t], path[t]]
        yield path, p


def test_forward_and_counts_equal_the_sum_over_all_paths():
    model = small_model()
    sequences = [[5], [1, 2, 3, 1], [hmm.CLASSES, 7], [4, 4, 4]]
    classes = np.array(sum(sequences, []))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    got = hmm._log10_forward(model, classes, first)
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros_like(model.emit)
    for s, sequence in enumerate(sequences):
        total = sum(p for _, p in paths(model, sequence))
        assert abs(got[s] - math.log10(total)) < 1e-9
        for path, p in paths(model, sequence):
            starts[path[0]] += p / total
            for t, state in enumerate(path):
                emits[sequence[t], state] += p / total
                if t:
                    moves[path[t - 1], state] += p / total
    a, b, c = hmm.expected(model, classes, first)
    assert np.allclose(a, starts) and np.allclose(b, moves) and np.allclose(c, emits)


def test_rounds_raise_the_likelihood_and_long_texts_are_whole():
    rng = np.random.default_rng(2)
    classes = np.concatenate([rng.integers(0, 30, 3000), rng.integers(30, 60, 3000)])
    first = np.array([0, 3000, 6000])
    model = small_model(2)
    scores = []
    for _ in range(4):
        scores.append(hmm._log10_forward(model, classes, first).sum())
        a, b, c = hmm.expected(model, classes, first)
        model = hmm.Hmm(a / a.sum(), b / b.sum(axis=1, keepdims=True), (c + 1e-9) / (c + 1e-9).sum(axis=0))
    assert all(y >= x - 1e-6 for x, y in zip(scores, scores[1:], strict=False)) and np.isfinite(scores).all()


def test_base_columns_equal_brute_force_and_held_out_texts_gain(spark):
    import __spark_entry__ as e

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(DOCS).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    count = Counter()
    for i, text in rows.items():
        if not held[i]:
            count.update([*black_words(text), None])
    n, v = sum(count.values()), len(count)
    got = e.queries()["op7_hmm_lm"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == len(rows) and set(got.doc_id) == set(rows)
    for r in got.itertuples():
        tokens = [*black_words(rows[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(t in count for t in tokens), n)
        assert abs(r.base_score - sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)) < 1e-6
    out = got[got.held_out]
    assert (out.score.sum() - out.base_score.sum()) / out.n_tokens.sum() > 0.02
    assert np.isfinite(got.score).all() and (got.score < 0).all()


def test_word_shares_of_a_class_sum_to_one(spark):
    docs = spark.read.parquet(DOCS)
    tokens = hmm.tokenize(docs, "doc_id", "text", F.lit(False))
    counts = hmm.word_counts(tokens)
    totals = hmm.ClassTotals.of(counts)
    pdf = counts.toPandas()
    classes = hmm.class_of(pdf["h"].to_numpy().view(np.uint64))
    share = (pdf["c"].to_numpy() + 1) / (totals.tokens + totals.words + 1)[classes]
    whole = np.bincount(classes, weights=share, minlength=hmm.CLASSES + 1) + 1 / (totals.tokens + totals.words + 1)
    assert np.allclose(whole, 1)
    model = hmm.baum_welch(tokens, hmm.seeded(docs, "doc_id", "text", F.lit(False), totals), totals)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and abs(model.start.sum() - 1) < 1e-9


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 200)
    monkeypatch.setattr(hmm, "SEGMENT", 16)
    docs = with_clashing_columns(odd_documents(spark))
    got = hmm.score(docs, crc_bucket(F.col("doc_id"), 7) == 2).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["n_tokens"] == 1 for i in (1, 2, 3)) and by[0]["score"] == by[5]["score"]
    assert all(by[i]["n_tokens"] == len(black_words(t)) + 1 for i, t, *_ in ODD)
    assert hmm.score(odd_documents(spark, []), F.lit(False)).count() == 0
    alone = hmm.score(docs, F.lit(True)).collect()
    assert len(alone) == len(ODD) and {r["n_known"] for r in alone} == {0} and all(np.isfinite(r["score"]) for r in alone)


def plain_baum_welch(model, texts, shares):
    """One round over whole texts in one process, a token at a time."""
    states = len(model.start)
    starts, moves, emits, likelihood, n = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit), 0.0, 0
    for classes in texts:
        alpha, scale = [], []
        for t, c in enumerate(classes):
            value = model.emit[c] * (alpha[-1] @ model.move if t else model.start)
            scale.append(value.sum())
            alpha.append(value / scale[-1])
        beta = np.ones(states)
        for t in range(len(classes) - 1, -1, -1):
            emits[classes[t]] += alpha[t] * beta
            if t:
                later = model.emit[classes[t]] * beta / scale[t]
                moves += np.outer(alpha[t - 1], later) * model.move
                beta = model.move @ later
            else:
                starts += alpha[0] * beta
        likelihood, n = likelihood + np.log(scale).sum(), n + len(classes)
    emit, start, move = emits + hmm.PRIOR * shares[:, None], starts + 0.1, moves + 0.1
    return start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), likelihood / n


def test_a_round_over_partitions_equals_the_plain_one(spark, monkeypatch):
    """Whole texts, many pieces and blocks: starts only where texts start, moves across all pieces."""
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 20_000)
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{rng.integers(0, 40) + 40 * (j // 90 % 2)}" for j in range(rng.integers(0, 700)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.col("doc_id") % 5 == 0
    tokens = hmm.tokenize(docs, "doc_id", "text", held)
    totals = hmm.ClassTotals.of(hmm.word_counts(tokens))
    model = hmm.seeded(docs, "doc_id", "text", held, totals, 3)
    got = hmm.baum_welch(tokens, model, totals)
    from tessera.llm.bytescan import span_hashes

    def classes(text):
        words = text.encode().split()
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        end = np.cumsum([len(w) for w in words]).astype(np.int64) if words else np.zeros(0, np.int64)
        hashes = span_hashes(data, np.concatenate([[0], end[:-1]]) if words else end, end)
        return [*hmm.class_of(hashes).tolist(), hmm.CLASSES]

    start, move, emit, likelihood = plain_baum_welch(model, [classes(t) for i, t in rows if i % 5], totals.shares())
    assert np.allclose(got.start, start) and np.allclose(got.move, move) and np.allclose(got.emit, emit)
    assert abs(got.likelihood - likelihood) < 1e-9
    assert hmm.baum_welch(tokens, got, totals).likelihood > got.likelihood
