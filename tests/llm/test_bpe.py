import random

import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe
from tests.llm.helpers import ODD, odd_documents, with_clashing_columns


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.Coder(bpe.default_vocabulary())


def same(own, library, texts):
    ids, first = own.encode(texts)
    cut = first.tolist()
    got = [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [x.decode() for x in own.decode(ids, first)] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_odd_texts(own, library):
    same(own, library, ["", "<|endoftext|>a b<|endoftext|>", "aaaaaaaaaaa aaaaaaa", "   x  \n\n y\t", "héllo 日本語 😀😀 1234 'll I'll we've 've", "\x00\x01​", "<|endoftext", "a" * 5000, " " * 3000, "'s's's ' s"])


def test_random_texts(own, library):
    rng = random.Random(5)
    letters = [*"ab'stredvlm 1\n.é\t", "'s", "'ll", " '", "  ", "<|endoftext|>", "　", "٣", "😀"]
    same(own, library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(5000)])


def test_whole_table_and_repairs(own, library, spark):
    texts = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    same(own, library, texts)
    assert 0 < own.repaired < own.speculated


def test_memory_limits_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 10)
    monkeypatch.setattr(bpe, "MEMORY_PAIRS", 10)
    small = bpe.Coder(bpe.default_vocabulary())
    for k in range(5):
        same(small, library, [f"some words are new {k} and others return <|endoftext|> the the", "unbelievable antidisestablishmentarianism"])


def test_operator_on_odd_rows(spark, library):
    docs = with_clashing_columns(odd_documents(spark))
    got = {(r[0], r["decoded"].decode()): r["ids"] for r in bpe.encode_texts(docs).collect()}
    for i, text, *_ in ODD:
        assert got[i, text or ""] == library.encode(text or "", add_special_tokens=False).ids
    packed = bpe.encode_texts(docs, pack=True).where("doc_id = 9").collect()
    assert len(packed) == 2 and all(int.from_bytes(r["ids"], "little") == got[9, "one"][0] for r in packed)
    assert bpe.encode_texts(odd_documents(spark, [])).count() == 0


def complementary_words(letters="ab", lengths=(1024, 2048)):
    """Two-letter Thue-Morse words and their complements: they collide under polynomial hashes modulo 2 ** 64."""
    out = []
    for n in lengths:
        bits = [bin(i).count("1") & 1 for i in range(n)]
        out += ["".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)]
    return out


def test_complementary_words(own, library):
    same(own, library, complementary_words())
    for word in complementary_words("xy"):  # across calls, through the memory
        same(own, library, [word, f"{word} {word}"])


def test_equal_hashes_are_told_apart(library, monkeypatch):
    """With a hash that knows lengths only, the code points still decide."""
    monkeypatch.setattr(bpe, "span_hashes", lambda points, start, stop: (stop - start).astype("uint64"))
    weak = bpe.Coder(bpe.default_vocabulary())
    for k in range(3):
        same(weak, library, [f"one two six ten {k} <|endoftext|> cat dog", "aa bb", "", "cc bb aa"])
