from tessera.llm import decontam
from tests.llm.helpers import ODD, alnum_words, odd_documents, with_clashing_columns

BENCH = [
    ("a", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    ("b", "Short, item!"),
    ("c", None),
    ("d", ""),
    ("e", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (None, "nobody names this item"),
    ("f", "... !!!"),
    ("g", "uno dos tres cuatro cinco seis siete ocho nueve diez once"),
]
TEXTS = [
    "before ALPHA beta, gamma delta epsilon zeta eta theta iota-kappa LAMBDA mu after",
    "alpha beta gamma delta epsilon zeta eta theta iota",
    "a short item. and one more Short Item",
    "xx nobody names this item yy",
    "dos tres cuatro cinco seis siete ocho nueve diez once uno dos tres",
    "",
    None,
    "short\nitem" * 3,
    "é short item é " + "word " * 50000 + "short item",
]


def brute(text, bench):
    w, hit, items = alnum_words(text), set(), set()
    for item, t in bench:
        q = alnum_words(t)
        size = min(10, len(q))
        windows = {tuple(q[i : i + size]) for i in range(len(q) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                if item is not None:
                    items.add(item)
    return len(w), len(hit), sorted(items)


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id string, text string")


def rows_of(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in df.collect()}


def test_hits_equal_brute_force_in_one_block_and_in_many(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {i: brute(t, BENCH) for i, t in enumerate(TEXTS)}
    assert rows_of(decontam.scan_documents(docs, bench(spark))) == want
    assert rows_of(decontam.scan_documents(docs, bench(spark), block_bytes=60)) == want
    assert want[0][1] == 12 and want[3][1] == 4 and want[3][2] == []


def test_spans_are_cut_and_documents_dropped(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontam.cut_spans(decontam.scan_documents(docs, bench(spark))).collect()}
    assert cut[0] == "before  after" and cut[1] == TEXTS[1] and cut[5] == "" and cut[6] is None
    assert cut[2] == "a . and one more " and cut[8].startswith("é  é word")
    left = decontam.clean_documents(with_clashing_columns(docs), bench(spark))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 5, 6, *([7] if not brute(TEXTS[7], BENCH)[1] else [])]


def test_odd_rows_and_empty_tables(spark):
    docs = with_clashing_columns(odd_documents(spark))
    got = decontam.scan_documents(docs, bench(spark))
    assert got.count() == len(ODD) and got.where("n_hit > 0").count() == 0
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontam.scan_documents(docs, none).where("n_hit = 0").count() == len(ODD)
    assert decontam.scan_documents(odd_documents(spark, []), bench(spark)).count() == 0
    assert decontam.clean_documents(docs, bench(spark)).columns == docs.columns


def test_blocks_are_bounded_and_repeated_texts_are_one(spark):
    same = "one two three four five six seven eight nine ten eleven"
    rows = [(f"r{i}", same) for i in range(500)] + [(f"u{i}", f"item {i} " + " ".join(f"w{i}x{j}" for j in range(12))) for i in range(60)] + [(None, same), ("e", ""), ("n", None)]
    bench = spark.createDataFrame(rows, "item_id string, text string")
    blocks = list(decontam.benchmark_blocks(bench, "item_id", "text", block_bytes=1500))
    assert len(blocks) > 2 and sum(len(b.items) for b in blocks) == 61
    assert max(len(ids) for b in blocks for ids in b.items) == 500
    docs = spark.createDataFrame([(1, f"so {same} and w3x0"), (2, " ".join(f"w7x{j}" for j in range(12)))], "doc_id long, text string")
    got = {r["doc_id"]: (r["items"], r["n_hit"]) for r in decontam.scan_documents(docs, bench, block_bytes=1500).collect()}
    assert got == {1: (sorted(f"r{i}" for i in range(500)), 11), 2: (["u7"], 12)}
