import random
import re
from re import _parser

from tessera.llm import licenses
from tessera.llm.license_rules import rules
from tests.llm.helpers import ODD, alnum_words, odd_documents, with_clashing_columns

TEXTS = [
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0; MIT  license too. MIT-License",
    "GNU Lesser General Public License v3 and the GNU General Public License",
    "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "nothing to see, permit license, summit licenses",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
    "Redistribution and use in source and binary forms, with or without modification, are",
    "",
    None,
    "mit license " * 500,
]


def brute(text):
    """All rules on the whole normalised text, no keyword gate; suppression by comparing all pairs."""
    w = alnum_words(text)
    joined = " ".join(w)
    base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    every = rules()
    found = []
    for k, r in enumerate(every):
        for m in re.finditer(rf"(?<![^ ])(?:{r.pattern})(?![^ ])", joined):
            a = joined[: m.start()].count(" ")
            found.append((k, a, a + m[0].count(" ")))
    key = lambda x: (-every[x[0]].priority, x[1] - x[2], x[1], x[0])
    kept = []
    for x in found:
        if not any(y[1] <= x[1] and x[2] <= y[2] and key(y) < key(x) for y in found):
            kept.append(x)
    return len(w), base, sorted((a, b, every[k].name) for k, a, b in kept)


def as_tuple(r):
    return r["n_words"], [(x["first"], x["label"]) for x in r["base"]], sorted((x["first"], x["last"], x["rule"]) for x in r["detections"])


def test_equals_ungated_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: as_tuple(r) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: as_tuple(r) for r in licenses.scan(docs).collect()}
    want = {r["doc_id"]: brute(r["text"]) for r in docs.collect()}
    assert got == want


def test_labels_and_suppression(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {r["doc_id"]: {x["label"] for x in r["detections"]} for r in licenses.scan(docs).collect()}
    assert labels[0] == {"mit"} and labels[3] == {"cc-by-nc"} and labels[4] == {"gpl"} and labels[5] == set()
    assert labels[2] == {"lgpl", "gpl"} and labels[6] == {"mit"} and labels[7] == {"bsd"}


def test_rules_are_hundreds_and_their_keywords_are_in_every_match():
    every = rules()
    assert len(every) > 300 and len({r.name for r in every}) == len(every)
    for r in every:
        assert re.fullmatch(r"[a-z0-9]+", r.keyword)
    assert {r.keyword for r in every if r.name.endswith("-title")} == {"licen"}


def test_odd_rows(spark):
    docs = with_clashing_columns(odd_documents(spark))
    got = licenses.scan(docs)
    assert got.count() == len(ODD) and got.where("size(base) > 0 OR size(detections) > 0").count() == 0
    assert licenses.scan(odd_documents(spark, [])).count() == 0


def made_match(parsed, rng):
    """A random text that the parsed pattern matches (look-aheads are left to the caller's check)."""
    out = ""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "NOT_LITERAL":
            out += rng.choice("abcxyz019")
        elif kind == "IN":
            what, value = rng.choice(arg)
            if str(what) == "LITERAL":
                out += chr(value)
            elif str(what) == "RANGE":
                out += chr(rng.randint(*value))
            else:
                assert str(value) == "CATEGORY_WORD"
                out += rng.choice("abcxyz019")
        elif kind == "BRANCH":
            out += made_match(rng.choice(arg[1]), rng)
        elif kind == "SUBPATTERN":
            out += made_match(arg[3], rng)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = arg
            for _ in range(rng.randint(least, min(int(most), least + 14))):
                out += made_match(inner, rng)
        else:
            assert kind == "ASSERT_NOT", kind
    return out


def test_every_generated_match_holds_its_keyword():
    rng = random.Random(5)
    for r in rules():
        parsed = _parser.parse(r.pattern)
        for _ in range(40):
            text = made_match(parsed, rng)
            assert re.fullmatch(r.pattern, text), (r.name, text)
            assert r.keyword in text, (r.name, text)


def test_bsd_3_name_without_contributors_and_with_long_names(spark):
    end = "may be used to endorse or promote products derived from this software"
    texts = [
        f"Neither the name of the University nor of the Laboratory {end}.",
        f"Neither the name of the Regents of the Distant State University and Polytechnic of the Northern Coast nor the names of its contributors {end}.",
        f"Neither the name of the {'Very ' * 60}Long Name Society {end}.",
        f"Neither the name of the “Müller – Söhne” trust {end}.",
        f"Neither the name of A. Neither the name of B {end}.",
        "Neither the name of the contributors is known here.",
        "neither the name of " * 3000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: as_tuple(r) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert [[name for *_, name in got[i][2]] for i in range(7)] == [["bsd-3-name"]] * 5 + [[]] * 2


def test_every_generated_match_holds_what_its_pattern_needs():
    rng = random.Random(6)
    for r in rules():
        clauses, parsed = licenses.needed(r.pattern), _parser.parse(r.pattern)
        for _ in range(40):
            text = made_match(parsed, rng)
            assert all(any(w in text for w in c) for c in clauses), (r.name, text, clauses)
    names = {r.label: licenses.needed(r.pattern) for r in rules() if r.name.endswith("-title")}
    assert any("mozilla" in c for c in names["mpl"])
    assert sum(any(not c & {"licen", "licence", "license"} for c in clauses) for clauses in names.values()) > 0.9 * len(names)
