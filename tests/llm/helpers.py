"""Odd tables that every operator must take: nulls, empty, long, repeated, clashing names."""

from __future__ import annotations

import re

ODD = [
    (0, "The cat sat on the mat by the door of the house today.\nAnother line of seven words follows here now.", "en", "a", 1),
    (1, None, "en", "a", None),
    (2, "", None, "b", 0),
    (3, "   \n\t \n", "de", "b", 6),
    (4, "12345 67890 !!!", "de", None, 15),
    (5, "The cat sat on the mat by the door of the house today.\nAnother line of seven words follows here now.", "en", "a", 1),
    (None, "The cat sat on the mat by the door of the house today.", "en", "a", 3),
    (7, "Der Hund läuft über die Straße und bellt sehr laut heute Abend. " * 400, "de", "c", 9),
    (8, "Le chat ÉLÉGANT dort 日本語 😀 <|endoftext|> fin", "fr", "c", 9),
    (9, "one", "en", "a", 3),
    (9, "one", "en", "a", 3),
    (10, "The cat sat on the mat by the door of the house tonight.\n\nshort\nshort", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark, rows=None):
    return spark.createDataFrame(ODD if rows is None else rows, SCHEMA)


def with_clashing_columns(docs):
    """Extra columns named like those the operators use inside or return."""
    from pyspark.sql import functions as F

    names = ["id", "row", "n", "h", "key", "keys", "sig", "line", "first", "items", "spans", "ids", "decoded", "score", "component", "component_id", "rep", "near", "exact", "words", "label", "value", "k", "n_tokens"]
    return docs.withColumns({c: F.lit("x") for c in names})


def black_words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def alnum_words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
