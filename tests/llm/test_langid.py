import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid
from tests.llm.helpers import ODD, odd_documents, with_clashing_columns

DOCS = "/root/testdata/sf0.01/documents.parquet"


def brute_bits(counts, text: bytes, order: int) -> float:
    """Code length of one text, byte by byte, from counts[context][byte]."""
    total = 0.0
    for i, b in enumerate(text):
        p = 1.0
        for k in range(min(order, i), -1, -1):
            seen = counts.get(text[i - k : i])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if b in seen:
                p *= seen[b] / (n + d)
                break
            p *= d / (n + d)
        else:
            p /= 256
        total -= np.log2(p)
    return total


def test_code_lengths_equal_a_byte_by_byte_coder(spark, monkeypatch):
    monkeypatch.setattr(langid, "MIN_CONTEXT", 1)
    rows = [(0, "banana bandana", "x", "", 0), (1, "bananas and cabanas", "x", "", 0), (2, "über öde brücken", "y", "", 0)]
    model = langid.fit(odd_documents(spark, rows))
    trained = {}
    for lang in ("x", "y"):
        # contexts are shared by the languages: one that a language never saw is skipped
        counts = trained.setdefault(lang, {})
        for _, text, own, *_ in rows:
            raw = text.encode()
            if own == lang:
                for i, b in enumerate(raw):
                    for k in range(min(langid.ORDER, i) + 1):
                        seen = counts.setdefault(raw[i - k : i], {})
                        seen[b] = seen.get(b, 0) + 1
    texts = [b"banana", b"x", "über banane".encode(), b"", b"zzz and \xff"]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.bits(np.frombuffer(b"".join(texts), dtype=np.uint8), at)
    for j, lang in enumerate(model.languages):
        for t, bits in zip(texts, got[:, j], strict=True):
            assert abs(bits - brute_bits(trained[lang], t, langid.ORDER)) < 1e-3


def test_held_out_accuracy_and_buckets(spark):
    import __spark_entry__ as e

    docs = spark.read.parquet(DOCS)
    got = e.queries()["op1_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = with_clashing_columns(odd_documents(spark))
    model = langid.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    got = {(r[0]): (r["lang_pred"], r["score"], r["bits_per_byte"]) for r in langid.score(docs, model).collect()}
    assert all(got[i] == ("und", 0.0, None) for i in (1, 2, 3, 4))
    assert got[0][0] == "en" and got[7][0] == "de" and got[8][0] == "fr"
    assert langid.score(docs, model).count() == len(ODD)
    kept = langid.keep_known(docs, model, max_bits=8.0)
    assert kept.columns == docs.columns
    assert kept.where(F.col("doc_id").isin(1, 2, 3, 4)).count() == 0 and kept.count() == len(ODD) - 4
    assert kept.where("doc_id = 8").first()["text"] == ODD[8][1]


def test_nothing_to_learn_from(spark):
    none = odd_documents(spark, [])
    model = langid.fit(none)
    assert model.languages == [] and langid.score(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.score(odd_documents(spark), model).collect()} == {"und"}


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.read.parquet(DOCS)
    a = langid.sample(docs, "doc_id", "text", "lang", 30).collect()
    b = langid.sample(docs.repartition(7), "doc_id", "text", "lang", 30).collect()
    assert sorted(a) == sorted(b)
    assert all(0 < sum(r["lang"] == lang for r in a) <= 30 for lang in {r["lang"] for r in a})


def test_whole_trees_of_many_languages(spark, monkeypatch):
    """More than 256 languages, in several blocks: every context of each counts."""
    monkeypatch.setattr(langid, "BLOCK_GRAMS", 5000)
    rng = random.Random(3)
    texts = {f"l{k:03d}": " ".join("".join(rng.choices(rng.sample("abcdefghijklmnopqrstuvwxyz", 7), k=6)) for _ in range(12)) for k in range(300)}
    rows = [(k, text, lang, "", 0) for k, (lang, text) in enumerate(texts.items())]
    docs = odd_documents(spark, rows)
    model = langid.fit(docs)
    assert model.languages == sorted(texts) and len(model.blocks) > 1
    judged = [texts["l000"].encode(), texts["l299"].encode()[:40], b"zebra \xff"]
    got = model.bits(np.frombuffer(b"".join(judged), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in judged])]))
    for lang in ("l000", "l001", "l150", "l299"):
        raw, counts = texts[lang].encode(), {}
        for i, b in enumerate(raw):
            for k in range(min(langid.ORDER, i) + 1):
                seen = counts.setdefault(raw[i - k : i], {})
                seen[b] = seen.get(b, 0) + 1
        for t, bits in zip(judged, got[:, model.languages.index(lang)], strict=True):
            assert abs(bits - brute_bits(counts, t, langid.ORDER)) < 1e-3
    named = {r["doc_id"]: r["lang_pred"] for r in langid.score(docs, model).collect()}
    assert named == {k: lang for k, _, lang, *_ in rows}
