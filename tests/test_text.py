import pytest

from tessera.functions.text import (
    derived_title,
    first_paragraph,
    paragraphs,
    py_strip,
    title_is_valid,
)

# Title validity cases (digits per Python isdigit, ASCII punctuation only).
TITLES = [
    ("Turkish folklore", True),
    ("唐朝", True),
    ("Jean-Paul", False),
    ("Côte d'Ivoire", False),
    ("Côte d’Ivoire", True),
    ("東京（曖昧さ回避）", True),
    ("Area 51", False),
    ("Ruta ４", False),
    ("Km²", False),
    ("Ⅳ", True),
]


def test_title_validity(spark):
    df = spark.createDataFrame(TITLES, "title string, expected boolean")
    got = df.select("title", "expected", title_is_valid("title").alias("v")).collect()
    for r in got:
        assert r["v"] == r["expected"], r["title"]


def test_title_validity_matches_python_on_all_digit_like_chars(spark):
    import string

    chars = [chr(c) for c in range(0x20, 0x20000) if chr(c).isdigit()][::7] + list(string.punctuation)
    chars += ["a", "é", "’", "（", "・", "Ⅳ", "　"]
    df = spark.createDataFrame([(c,) for c in chars], "title string")
    got = {r["title"]: r["v"] for r in df.select("title", title_is_valid("title").alias("v")).collect()}
    for c in chars:
        expected = not (c.isdigit() or c in string.punctuation)
        assert got[c] == expected, hex(ord(c))


def test_py_strip_matches_python(spark):
    samples = [
        "  a b  ",
        "　x ",
        "\x1c\x1dmid\x1e\x1f",
        " \u0085keep​",  # U+200B is not whitespace for Python
        "",
        "\t\n\x0b\x0c\r",
        "     z",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(py_strip("s")).collect()]
    assert got == [s.strip() for s in samples]


def test_first_paragraph_and_derived_title(spark):
    rows = [("Hello world.\nSecond",), ("\nstarts with newline",), (None,), ("Paris! is here",), ("",)]
    df = spark.createDataFrame(rows, "text string")
    out = df.select(first_paragraph("text").alias("fp"), derived_title("text").alias("t")).collect()
    assert [r["fp"] for r in out] == ["Hello world.", "", "", "Paris! is here", ""]
    assert [r["t"] for r in out] == ["Hello", "", "", "Paris", ""]


def test_paragraphs_match_python(spark):
    text = "  one \n\n two\n　\nthree  \n"
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(paragraphs("text")).first()[0]
    assert got == [p.strip() for p in text.split("\n") if p.strip()]


@pytest.mark.parametrize("text", ["A", "A b", "Ünïcode Wörds here"])
def test_tokens_consistent_with_python_embedder(spark, text):
    from tessera.functions.text import tokens
    from tessera.operators.embed import _TOKEN_RE

    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tokens("text")).first()[0] == _TOKEN_RE.findall(text.lower())
