import random

from pyspark.sql import functions as F

from tessera.llm import linededup
from tests.llm.helpers import ODD, black_words, odd_documents, with_clashing_columns


def brute(rows):
    """(doc_id, line) -> 'exact' or 'near' of the lines that go."""
    lines = []
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n")):
            w = black_words(line)
            if w:
                lines.append((i, k, w))
    gone = {}
    for b, (i, k, w) in enumerate(lines):
        for j, m, v in lines[:b]:
            if v == w and (i, k) != (j, m):
                gone[i, k] = "exact"
                break
            if min(len(v), len(w)) >= linededup.NEAR_WORDS:
                near = distance_at_most_one(v, w)
            else:
                x, y = " ".join(v), " ".join(w)
                near = max(len(v), len(w)) < linededup.NEAR_WORDS and min(len(x), len(y)) >= linededup.NEAR_CHARS and distance_at_most_one(x, y)
            if near:
                gone[i, k] = "near"
    return gone


def distance_at_most_one(a, b):
    """Dynamic programming, nothing clever."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        before, row[0] = row[0], x
        for y in range(1, len(b) + 1):
            before, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, before + (a[x - 1] != b[y - 1]))
    return row[-1] <= 1


def made_up(seed=1, n=120):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("aa bb cc dd ee ff gg hh".split()) * rng.choice([1, 1, 3]) for _ in range(rng.choice([1, 2, 3, 6, 7, 8, 9, 12]))) for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(pool).split()
            change = rng.random()
            if change < 0.3:
                w[rng.randrange(len(w))] = rng.choice(["zz", "aa", "q%d" % rng.randint(0, 50)])
            elif change < 0.4:
                del w[rng.randrange(len(w))]
            elif change < 0.5:
                w.insert(rng.randrange(len(w) + 1), rng.choice(["zz", "yy"]))
            lines.append((" " if change < 0.7 else "  ").join(w).upper() if rng.random() < 0.1 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows


def found(docs):
    out = {}
    for r in linededup.repeated_lines(docs).collect():
        out |= {(r[0], k): "exact" for k in r["exact"]} | {(r[0], k): "near" for k in r["near"]}
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = made_up(seed)
        want = brute(rows)
        assert {"exact", "near"} <= set(want.values())
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want


def test_one_line_with_many_variants_keeps_the_earliest(spark):
    rows = [(k, f"item number {k} of the long catalogue is sold out\nother line {k}") for k in range(300)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {(k, 0): "near" for k in range(1, 300)}


def test_odd_rows(spark):
    docs = with_clashing_columns(odd_documents(spark))
    assert found(docs) == brute([r[:2] for r in ODD])
    left = linededup.dedup_lines(docs)
    assert left.columns == docs.columns
    assert 10 not in {r["doc_id"] for r in left.collect()}  # one word of fifteen is left
    left = linededup.dedup_lines(docs, least_left=0)
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert 5 not in texts and texts[1] is None and texts[2] == "" and texts[3] == ODD[3][1]
    # every line that is not blank is compared: the second "short" goes; rows that repeat an id are one document
    assert texts[10] == "\nshort" and texts[None] == ODD[6][1]
    assert left.where("doc_id = 9").count() == 2


def test_input_columns_may_have_the_names_of_the_counts(spark):
    docs = odd_documents(spark).withColumns({c: F.lit("x") for c in ["exact_lines", "near_lines", "words", "words_left", "row", "__id", "__text", "__gone", "g", "halves"]})
    left = linededup.dedup_lines(docs)
    assert left.columns == docs.columns and {r["near_lines"] for r in left.collect()} == {"x"}


def test_short_lines_and_lines_without_spaces(spark):
    han = "昔々あるところにおじいさんとおばあさんが住んでいました"
    rows = [
        (1, "ok\n" + han + "\nReference number 2024-117-A"),
        (2, "OK\n" + han[:5] + "X" + han[6:] + "\nreference number 2024-118-A"),
        (3, han[:-1] + "\nok then\nReference  number 2024-117-A."),
        (4, han[::-1] + "\nReference number 99"),
        (5, "x" * 5000 + "\n" + "x" * 4000 + "y" + "x" * 999),
    ]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) == {(2, 0): "exact", (2, 1): "near", (2, 2): "near", (3, 0): "near", (3, 2): "near", (5, 1): "near"}


def test_complementary_lines_stay(spark):
    """Two-letter Thue-Morse words and lines and their complements, which collide under polynomial hashes."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    rows = [(0, "".join("ab"[b] for b in bits)), (1, "".join("ba"[b] for b in bits)), (2, " ".join("ab"[b] for b in bits)), (3, " ".join("ba"[b] for b in bits))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == {}


def test_what_is_left_of_a_copy_goes(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("some words that make a line of text with nothing in common".split()) for _ in range(12)) for _ in range(20)]
    text = "\n".join(lines)
    catalogue = "\n".join(f"Item {i} of a catalogue whose lines are all alike but for a number" for i in range(20))
    rows = [(1, text), (2, text + "\nand one line more"), (3, "A line of its own, which nobody else has in this way\n" + lines[0]), (4, catalogue)]
    left = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"].count("\n") for r in left} == {1: 19, 3: 0, 4: 0}


def test_empty_table(spark):
    none = odd_documents(spark, [])
    assert linededup.repeated_lines(none).count() == 0 and linededup.dedup_lines(none).count() == 0


def test_edit_check():
    assert linededup.within_one_edit([b"a", b"b"], [b"a", b"c"]) and linededup.within_one_edit([b"a"], [b"a", b"b"])
    assert linededup.within_one_edit([b"b", b"a"], [b"a"]) and not linededup.within_one_edit([b"a", b"b"], [b"b", b"a"])
    assert not linededup.within_one_edit([], [b"a", b"b"]) and linededup.within_one_edit([], [])
