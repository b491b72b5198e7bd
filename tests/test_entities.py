from pyspark.sql import functions as F

from tessera.operators.entities import ENTITY_TYPE, annotate_entities, ner_records, title_entity_overlap
from tessera.functions.text import title_is_valid

# (lang, title, entities, selected)
OVERLAP = [
    ("en", "Lviv Theatre", [("Lviv", "GPE")], True),
    ("en", "Lviv", [("History of Lviv", "ORG")], True),
    ("en", "Lviv", [("lviv", "GPE")], False),
    ("en", "Taras", [("Taras", "PERSON")], False),
    ("de", "Wien", [("Wien", "GPE")], False),
    ("de", "Wien", [("Wien", "LOC")], True),
    ("fr", "Paris", [("", "LOC")], False),
    ("fr", "Paris", [], False),
]


def test_overlap_table(spark):
    rows = [(l, t, [{"text": x, "label": y} for x, y in e], s) for l, t, e, s in OVERLAP]
    df = spark.createDataFrame(rows, f"lang string, title string, entities {ENTITY_TYPE.simpleString()}, expected boolean")
    sel = title_is_valid("title") & title_entity_overlap("entities", "title", "lang") & (F.size("entities") > 0)
    for r in df.select("title", "expected", sel.alias("s")).collect():
        assert r["s"] == r["expected"], r["title"]


def test_blank_rows_in_neither_route(spark):
    rows = [
        ("en", 1, "Vienna", "Vienna is a city"),
        ("en", 2, "   ", "Text"),
        ("en", 3, None, "Text"),
        ("en", 4, "Title", "\nstarts with newline"),
    ]
    corpus = spark.createDataFrame(rows, "lang string, idx bigint, title string, text string")
    out = ner_records(corpus).collect()
    assert [r["index"] for r in out] == [1]


def test_builtin_recogniser_spans(spark):
    corpus = spark.createDataFrame(
        [("en", 1, "Lviv", "Lviv Theatre opened in Lviv. the end"), ("ja", 2, "東京", "東京は日本の首都")],
        "lang string, idx bigint, title string, text string",
    )
    recs = {r["index"]: r for r in ner_records(corpus).collect()}
    assert [e["text"] for e in recs[1]["entities"]] == ["Lviv Theatre", "Lviv"]
    assert [e["text"] for e in recs[2]["entities"]] == ["東京", "日本", "首都"]


def test_recogniser_plugin_runs_in_map_in_pandas(spark):
    def fake(lang, texts):
        return [[(t.split()[0], "LOC")] if t else [] for t in texts]

    df = spark.createDataFrame([("de", "Wien ist schön"), ("de", "")], "lang string, ner_text string")
    out = annotate_entities(df, "ner_text", "lang", recognizer=fake).collect()
    assert out[0]["entities"][0]["text"] == "Wien"
    assert out[1]["entities"] == []


def test_plugin_keeps_rows_without_a_language_and_checks_counts(spark):
    import pytest

    def fake(lang, texts):
        return [[("Wien", "LOC")] for _ in texts]

    rows = [("de", 1, "Wien", "Wien ist schön"), (None, 2, "Wien", "Wien ist schön"), (None, 3, "Graz", "Graz")]
    corpus = spark.createDataFrame(rows, "lang string, idx bigint, title string, text string").coalesce(1)
    recs = {r["index"]: r for r in ner_records(corpus, fake).collect()}
    assert {i: r["selected"] for i, r in recs.items()} == {1: True, 2: True, 3: False}
    assert all(r["entities"] for r in recs.values())
    with pytest.raises(Exception, match="2 results for 1"):
        annotate_entities(spark.createDataFrame([("de", "x")], "lang string, ner_text string"), recognizer=lambda lang, texts: [[], []]).collect()


def test_spacy_plugin_is_gated():
    import importlib.util

    import pytest

    from tessera.operators.entities import SpacyRecognizer

    rec = SpacyRecognizer({"en": "en_core_web_lg"})
    if importlib.util.find_spec("spacy") is None:
        with pytest.raises(RuntimeError):
            rec("en", ["Vienna"])
    else:  # pragma: no cover - only where spaCy is installed
        with pytest.raises(ValueError):
            rec("xx", ["text"])


def test_selection_flag_agrees_with_records(spark):
    from tessera.operators.entities import selection_flag
    from tessera.sources.corpus import load_corpus
    from tests.conftest import SF_SMALL

    corpus = load_corpus(spark, SF_SMALL)
    flagged = {(r["lang"], r["idx"]) for r in selection_flag(corpus).where("selected").collect()}
    recs = {(r["lang_code"], r["index"]) for r in ner_records(corpus).where("selected").collect()}
    assert flagged == recs and len(flagged) > 0
