"""The pipeline against a plain Python version of all its stages."""

import hashlib
import os

from tokenizers import Tokenizer

from tessera.llm import bpe, linededup
from tests.llm.helpers import ODD, black_words, odd_documents
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_linededup import brute as repeated
from tests.llm.test_neardup import brute as components

SF = "/root/testdata/sf0.001"


def own_words(rows, text):
    """Words of a text without the lines that repeat others of its own."""
    own = {k for _, k in repeated(rows)}
    return sum(len(black_words(line)) for k, line in enumerate(text.split("\n")) if k not in own)


def by_hand(rows, bench):
    rows = {i: t for i, t in rows if t and any(map(str.isalpha, t))}
    gone = repeated(sorted(rows.items()))
    left = {}
    for i, text in rows.items():
        lost = {k for d, k in gone if d == i}
        kept = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in lost)
        said = own_words([(i, text)], text)
        if not lost or len(black_words(kept)) >= max(1, linededup.LEAST_LEFT * said):
            left[i] = kept
    group = components(sorted(left.items()))
    left = {i: t for i, t in left.items() if group[i][1] == i}
    left = {i: t for i, t in left.items() if not contaminated(t, bench)[1]}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items()}


def test_whole_pipeline_equals_the_plain_version(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = by_hand([(r["doc_id"], r["text"]) for r in docs], bench)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    langs = {r["doc_id"]: r["lang"] for r in docs}
    assert all(langs[r["doc_id"]] == r["lang"] for r in got)
    assert 0 < len(want) < len(docs)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == len(set(names)) == 5
    for rows in (ODD, [], [r for r in ODD if r[1] is None]):
        docs = odd_documents(spark, rows)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.store(stage(spark, docs, SF), "test")
            if k < 4:
                assert docs.columns == columns
        assert docs.count() == (0 if not any(r[1] for r in rows) else 6)  # of document 10 one word in fifteen is left


def test_sizes_follow_the_text(spark):
    import corpus_pipeline

    docs = odd_documents(spark, [(1, "one two three four\nfive six seven", "en", "a", 0), (2, "one two three four\neight", "en", "a", 0)])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {1: ("one two three four\nfive six seven", 33), 2: ("eight", 5)}


def test_op8_digests(spark):
    import __spark_entry__ as e

    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in e.queries()["op8_bpe"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nothing_of_a_driver_only_module_is_needed(spark):
    """All ten operators and the pipeline are registered, each with a docstring."""
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert os.path.exists(os.path.join(os.path.dirname(e.__file__), "corpus_pipeline.py"))


def test_texts_that_no_learned_language_explains_are_rejected(spark):
    """Greek, Italian in capitals without spaces, and noise among the given languages; clean documents stay."""
    import random

    import corpus_pipeline

    rng = random.Random(4)
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    greek = "".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω    ") for _ in range(600))
    noise = "".join(chr(rng.choice([*range(33, 127), *range(0x400, 0x460), *range(0x4E00, 0x4F00)])) for _ in range(600))
    strangers = [(-1, greek, None, "x", 600), (-2, noise, None, "x", 600), (-3, "12345 !!", None, "x", 8), (-4, None, None, "x", None)]
    docs = spark.createDataFrame(given + strangers, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).select("doc_id").collect()}
    assert not left & {-1, -2, -3, -4}
    assert len(left) > 0.97 * len(given)


def test_near_copies_do_not_survive_as_scraps(spark):
    """Most documents that the near-duplicate operator drops from the whole table are gone after both dedup
    stages; the others have enough words of their own left (their lines differ in more than one word)."""
    import corpus_pipeline
    from tessera.llm import neardup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dropped = {r["doc_id"]: r["text"] for r in docs.join(neardup.drop_near_duplicates(docs).select("doc_id"), "doc_id", "left_anti").collect()}
    after = corpus_pipeline.near_dedup(spark, corpus_pipeline.store(corpus_pipeline.line_dedup(spark, docs, SF), "test"), SF)
    kept = {r["doc_id"]: r["text"] for r in after.where("doc_id IS NOT NULL").collect() if r["doc_id"] in dropped}
    assert len(kept) < 0.5 * len(dropped)
    for i, text in kept.items():
        said = own_words([(i, dropped[i])], dropped[i])
        assert len(black_words(text)) >= linededup.LEAST_LEFT * said
