import hashlib
import json
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import queries, tokenalign
from tests.conftest import SF_SMALL
from tests.llm.helpers import ODD, odd_documents, with_clashing_columns


def plain_tokenizers():
    """Ids and bytes of a text under both vocabularies, whole texts, one at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = tokenalign.default_vocabularies()
    vocab = {i: t for t, i in json.load(open(a_path, encoding="utf-8"))["model"]["vocab"].items()}
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}

    def one(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in vocab[i]) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        return ids_a, bytes_a, ids_b, bytes_b

    return one


def brute(rows):
    """The contract's columns of ``(doc_id, text)`` rows, by scanning every pair of ends."""
    one, found, pairs = plain_tokenizers(), [], Counter()
    for doc, text in rows:
        entry = {"doc_id": doc, "n_a": 0, "n_b": 0, "n_groups": 0, "links": [], "groups_sha256": ""}
        if text:
            ids_a, bytes_a, ids_b, bytes_b = one(text)
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a = {sum(map(len, bytes_a[: i + 1])): i for i in range(len(ids_a))} if len(ids_a) < 400 else dict(zip(np.cumsum([len(x) for x in bytes_a]).tolist(), range(len(ids_a)), strict=True))
                ends_b = dict(zip(np.cumsum([len(x) for x in bytes_b]).tolist(), range(len(ids_b)), strict=True))
                common = sorted(set(ends_a) & set(ends_b))
                links = [(ids_a[ends_a[e]], ids_b[ends_b[e]]) for e in common]
                groups, i, j = [], 0, 0
                for e in common:
                    groups.append(",".join(map(str, ids_a[i : ends_a[e] + 1])) + "|" + ",".join(map(str, ids_b[j : ends_b[e] + 1])))
                    i, j = ends_a[e] + 1, ends_b[e] + 1
                pairs.update(links)
                entry |= {"n_a": len(ids_a), "n_b": len(ids_b), "n_groups": len(common), "links": links, "groups_sha256": hashlib.sha256(";".join(groups).encode()).hexdigest()}
        found.append(entry)
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(best.get(b, 0), n)
    for e in found:
        links = e.pop("links")
        e |= {"n_links": len(links), "n_best": sum(pairs[p] == best[p[1]] for p in links), "count_sum": sum(pairs[p] for p in links)}
    return found


def ordered(rows):
    return sorted((tuple(sorted((k, v) for k, v in r.items())) for r in rows), key=repr)


def test_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [r.asDict() for r in queries.op12_token_alignment(spark, SF_SMALL).collect()]
    assert ordered(got) == ordered(brute(rows))
    assert sum(r["n_groups"] for r in got) > 0


EXTRA = [(20, "a▁b", None, None, 0), (21, "  two  spaces \n\n\ttabs\x00nul ", None, None, 0), (22, "<s> </s> <unk> <0x41> <|endoftext|>", None, None, 0), (23, "word " * 60_000 + "x" * 3000, None, None, 0), (24, " 　  ", None, None, 0)]


def test_odd_rows(spark):
    rows = ODD + EXTRA
    docs = with_clashing_columns(odd_documents(spark, rows))
    got = [r.asDict() for r in tokenalign.link_counts(docs).collect()]
    assert ordered(got) == ordered(brute([r[:2] for r in rows]))
    assert [r["n_a"] for r in got if r["doc_id"] == 20] == [0]


def test_empty_table_and_nulls_only(spark):
    empty = odd_documents(spark, []).withColumn("x", F.lit(1))
    assert tokenalign.link_counts(empty).collect() == []
    assert [r["n_links"] for r in tokenalign.link_counts(odd_documents(spark, [(1, None, None, None, None), (None, "", None, None, None)])).collect()] == [0, 0]


def test_gallop_is_a_rank():
    rng = random.Random(4)
    for _ in range(300):
        n, m = rng.randint(0, 60), rng.randint(0, 400)
        short = np.array(sorted(rng.sample(range(500), n)), dtype=np.int64)
        long = np.array(sorted(rng.sample(range(500), m)), dtype=np.int64)
        assert tokenalign.gallop(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_groups_and_overlaps(spark):
    texts = [(i, t) for i, t in enumerate(["The cat's élégant 日本語 tokenization!!", "übermäßig 12345 aaaa   bbbb", "Ünïcödé\nlines\tand 😀😀"])]
    one = plain_tokenizers()
    for r in tokenalign.align_tokens(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        ids_a, bytes_a, ids_b, bytes_b = one(texts[r["doc_id"]][1])
        assert (r["a_ids"], r["b_ids"]) == (ids_a, ids_b)
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        assert [ends_a[i - 1] for i in r["a_ends"]] == common == [ends_b[i - 1] for i in r["b_ends"]]
        for i, end in enumerate(ends_a):
            start = end - len(bytes_a[i])
            over = [j for j, e in enumerate(ends_b) if e - len(bytes_b[j]) < end and e > start]
            assert list(range(r["overlap_first"][i], r["overlap_end"][i])) == over


def test_pairs_are_bounded_by_the_vocabularies():
    own = tokenalign.Vocabularies(*tokenalign.default_vocabularies())
    assert own.splits
    assert own.most_pairs() == 324_297


def test_ranked_ids_are_those_of_the_library():
    """The faster coder against the tokenizers library: random texts, every assigned character."""
    from tokenizers import Tokenizer

    own = tokenalign.Vocabularies(*tokenalign.default_vocabularies())
    assert own.ranked is not None
    library = Tokenizer.from_file(tokenalign.default_vocabularies()[0])
    library.encode_special_tokens = True
    rng = random.Random(9)
    letters = [*"ab'stredvlm 1\n.é\t", "'s", "'ll", " '", "  ", "<|endoftext|>", "　", "٣", "😀", "the", "ing", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    texts += ["".join(f" {chr(c)}a {chr(c)}1" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) or "x" for at in range(1, 0x30000, 64)]
    want = [x.ids for x in library.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
    a, first, _, _ = own.encode(texts)
    cut = first.tolist()
    assert [a[i:j].tolist() for i, j in zip(cut, cut[1:], strict=False)] == want


def test_long_texts_in_parts_give_the_same_ids(monkeypatch):
    own = tokenalign.Vocabularies(*tokenalign.default_vocabularies())
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "é", "'s", " 12", "　", "日", "!", " "]) for _ in range(400)) for _ in range(60)]
    whole = own.encode(texts)
    monkeypatch.setattr(tokenalign, "PART_BYTES", 20)
    assert sum(len(own._parts(t)) for t in texts) > 300
    for x, y in zip(whole, own.encode(texts), strict=True):
        assert x.tolist() == y.tolist()
