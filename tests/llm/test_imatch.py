import hashlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import imatch
from tests.llm.helpers import ODD, alnum_words, odd_documents, with_clashing_columns

DOCS = "/root/testdata/sf0.01/documents.parquet"


def edited(texts):
    out = []
    for k, text in enumerate(texts):
        quarter = len(text) // 4
        out.append(text[: len(text) - quarter] + texts[(k + 1) % len(texts)][:quarter])
    return out


def one(text, lexicon):
    raw = text.encode()
    return imatch.subset_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lexicon)


def test_lexicon_is_the_band_of_document_frequencies(spark):
    from collections import Counter

    texts = [r[0] for r in spark.read.parquet(DOCS).select("text").collect()]
    df = Counter(w for t in texts for w in set(alnum_words(t)))
    lexicon = imatch.build_lexicon(spark.read.parquet(DOCS), min_share=0.01, max_share=0.05)
    want = {w for w, n in df.items() if 0.01 * len(texts) <= n <= 0.05 * len(texts)}
    assert len(lexicon.terms) == len(want)
    raw = " ".join(sorted(want)).encode()
    value, _ = imatch.distinct_terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert lexicon.holds(value).all()


def test_edits_keep_likeness_and_strangers_have_none(spark):
    docs = spark.read.parquet(DOCS)
    lexicon = imatch.build_lexicon(docs)
    got = imatch.compared_with_next(docs, lexicon).toPandas().sort_values("doc_id")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    texts = [t or "" for _, t in rows]
    assert got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited(texts)]
    plain = imatch.fingerprints(docs, lexicon).toPandas().sort_values("doc_id")
    assert plain.fingerprint.tolist() == got.fingerprint.tolist()
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    differ = np.array([a != b for a, b in zip(texts, texts[1:] + texts[:1], strict=True)])
    assert (got.near_edited > got.near_next)[differ].mean() > 0.97
    assert got.near_edited.mean() > 0.3 and got.near_next[differ].mean() < 0.05
    for a, b in zip(got.fingerprint, got.edited_fingerprint, strict=True):
        assert len(a) == len(b) == 4 * imatch.LEVELS * imatch.COPIES


def test_terms_count_as_sets(spark):
    lexicon = imatch.Lexicon.of(np.zeros(0, dtype=np.uint64))
    assert (one("alpha beta, Gamma!", lexicon) == one("gamma BETA alpha alpha", lexicon)).all()
    assert (one("", lexicon) == 0).all() and (one("!!", lexicon) == 0).all()
    a, b = one("alpha beta gamma", lexicon), one("delta eps zeta", lexicon)
    assert imatch.likeness(a, a)[0] == 1.0 and imatch.likeness(a, b)[0] < 0.2


def test_odd_rows_one_partition_or_many(spark):
    docs = with_clashing_columns(odd_documents(spark))
    lexicon = imatch.build_lexicon(docs)
    want = None
    for n in ("1", "5", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((tuple(r) for r in imatch.compared_with_next(docs.repartition(3), lexicon).collect()), key=str)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(got) == len(ODD)
        want = want or got
        assert got == want
    ordered = sorted((r for r in ODD if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    by = {r[0]: r for r in want}
    texts = [r[1] or "" for r in ordered]
    for (i, *_), text in zip(ordered, edited(texts), strict=True):
        assert by[i][2] == hashlib.sha256(text.encode()).hexdigest(), i


def test_small_tables(spark):
    none = odd_documents(spark, [])
    lexicon = imatch.build_lexicon(none)
    assert imatch.compared_with_next(none, lexicon).count() == 0 and imatch.fingerprints(none, lexicon).count() == 0
    alone = odd_documents(spark, [(3, "alone in the world", "en", "a", 1)])
    row = imatch.compared_with_next(alone, imatch.build_lexicon(alone)).collect()
    assert len(row) == 1 and row[0]["near_next"] == 1.0


def test_string_ids_null_ids_and_repeated_ids(spark):
    """Any id that sorts; nulls and repeats spread over buckets and still follow each other."""
    texts = [f"text number {i} about thing {i % 7} and word{i * 31 % 97}" for i in range(120)]
    rows = [(None if i % 3 == 0 else "same" if i % 3 == 1 else f"id{i:03d}", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    lexicon = imatch.build_lexicon(docs)
    seen = None
    for n in ("1", "6"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((tuple(r) for r in imatch.compared_with_next(docs, lexicon).collect()), key=str)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        seen = seen or got
        assert got == seen and len(got) == 120
    hashed = [(r["doc_id"], r["text"]) for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(F.col("text").cast("binary"))).collect()]
    start = next(i for i, (k, _) in enumerate(hashed) if k is not None)
    following = [t for _, t in hashed[1:]] + [hashed[start][1]]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + f[: len(t) // 4]).encode()).hexdigest() for (_, t), f in zip(hashed, following, strict=True))
    assert sorted(r[2] for r in seen) == want


def plain_terms(text, lexicon):
    raw = " ".join(sorted(set(alnum_words(text)))).encode()
    value, _ = imatch.distinct_terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return set(value[lexicon.holds(value)].tolist())


def test_fingerprints_are_functions_of_the_kept_terms(spark):
    """A text has the fingerprint of its terms inside the band, whatever else it says and in whatever order."""
    docs = spark.read.parquet(DOCS)
    lexicon = imatch.build_lexicon(docs)
    texts = [r[0] for r in docs.select("text").limit(60).collect() if r[0]]
    prints = {}
    for text in texts:
        own = one(text, lexicon)[0].tobytes()
        assert one(" ".join(reversed(alnum_words(text))), lexicon)[0].tobytes() == own
        prints.setdefault(frozenset(plain_terms(text, lexicon)), set()).add(own)
    assert all(len(p) == 1 for p in prints.values()) and len(prints) > 30
