import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import neardup
from tessera.llm.components import components
from tests.llm.helpers import ODD, black_words, odd_documents, with_clashing_columns


def brute(rows):
    """id -> (set size, smallest id reachable over similarity >= 0.75); all pairs that share an element."""
    sets = {}
    for i, text in rows:
        w = black_words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[a], ids[b]] += 1
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def made_up_groups():
    """Chains, hubs and near misses around the threshold, from one vocabulary."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([20, 60, 150]))]
        for _ in range(rng.choice([1, 3, 30])):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
            if rng.random() < 0.2:
                base = text
    return rows


def test_components_equal_brute_force(spark):
    rows = made_up_groups()
    got = {r[0]: (r[1], r[2]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert sum(got[i] != want[i] for i in want) == 0
    assert len({c for _, c in want.values()}) < 0.7 * len(rows)


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = made_up_groups()
    got = {r[0]: (r[1], r[2]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r[0]: (r[1], r[2]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    docs = with_clashing_columns(odd_documents(spark))
    got = sorted(((r[0], r[1], r[2]) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(ODD)
    by = {i: (n, c) for i, n, c in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3)
    assert by[5][1] == 0 and by[None][1] is None and by[9] == (1, 9)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "1", "2", "3", "4", "None", "7", "8", "9", "9", "10"])


def test_empty_table(spark):
    assert neardup.near_duplicates(odd_documents(spark, [])).count() == 0
    assert neardup.drop_near_duplicates(odd_documents(spark, [])).count() == 0


def test_estimate_counts_equal_fields(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (50, 128), dtype=np.uint32)
    b = a.copy()
    for k in range(50):
        b[k, : 2 * k] += 1
    rows = [(x.tolist(), y.tolist()) for x, y in zip(neardup.pack(a), neardup.pack(b), strict=True)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select(neardup.equal_share("a", "b")).collect()]
    for k, x in enumerate(got):
        assert x == pytest.approx(((1 - 2 * k / 128) - 1 / 16) / (15 / 16))


def test_components_of_paths_and_hubs(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (130, 129)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 131))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_intersections_equal_set_operations(monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 40, 40, 25, 60)]
    got = neardup.intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))
