"""Column-level text functions (all JVM-side, no Python UDFs).

Python's ``str.strip()`` and ``str.isdigit()`` do not match Spark's ``trim`` or
Java's ``\\p{Nd}``. The character sets are therefore built here *by rule* from
the running Python's Unicode tables and handed to Spark as explicit sets, so the
JVM reproduces Python's string semantics exactly. The same strings are usable
verbatim by DuckDB (RE2 accepts the ``\\x{...}`` escapes), which keeps the SQL
oracles honest.
"""

from __future__ import annotations

import string
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ranges(code_points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in code_points:
        if out and cp == out[-1][1] + 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _class_body(code_points: list[int]) -> str:
    parts = []
    for lo, hi in _ranges(sorted(set(code_points))):
        parts.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
    return "".join(parts)


@lru_cache(maxsize=None)
def py_whitespace_chars() -> str:
    """The characters Python's ``str.strip()`` removes (rule: ``isspace``)."""
    return "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


@lru_cache(maxsize=None)
def title_invalid_class() -> str:
    """Regex class of characters that invalidate a title.

    Rule: every code point for which Python's ``isdigit()`` is true, plus the
    32 ASCII punctuation characters of ``string.punctuation``.
    """
    digits = [c for c in range(0x110000) if chr(c).isdigit()]
    punct = [ord(c) for c in string.punctuation]
    return "[" + _class_body(digits + punct) + "]"


# Separator class of the hashing tokenizer: ASCII characters that are not
# letters or digits. Tokens are maximal runs of anything else.
TOKEN_PATTERN = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"

# Runs of capitalised words (Latin, Greek, Cyrillic, ...) for the built-in
# recogniser. Han/Katakana runs are matched separately for zh/ja.
CAPITALISED_RUN_PATTERN = r"\p{Lu}[\p{L}\p{M}]*(?: \p{Lu}[\p{L}\p{M}]*)*"
# Han or Katakana runs (Hiragana is mostly particles and inflection).
CJK_RUN_PATTERN_JAVA = r"[\p{IsHan}\p{IsKatakana}\x{30fc}]+"
CJK_RUN_PATTERN_RE2 = r"[\p{Han}\p{Katakana}\x{30fc}]+"


def py_strip(col: Column | str) -> Column:
    """Python ``str.strip()`` on a string column (null stays null)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c, F.lit(py_whitespace_chars()))


def first_paragraph(text: Column | str) -> Column:
    """``text.split('\\n')[0]``, ``''`` when the text is null or empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.split_part(c, F.lit("\n"), F.lit(1)), F.lit(""))


def is_blank(col: Column | str) -> Column:
    """True when null or empty after Python-style strip."""
    s = py_strip(col)
    return s.isNull() | (F.length(s) == 0)


def title_is_valid(title: Column | str) -> Column:
    """No character is a digit (Python ``isdigit``) or ASCII punctuation."""
    c = F.col(title) if isinstance(title, str) else title
    return ~c.rlike(title_invalid_class())


def derived_title(text: Column | str) -> Column:
    """Title stand-in for corpora without one.

    First space-delimited token of the first paragraph, with trailing
    ``.,;:!?`` removed.
    """
    fp = first_paragraph(text)
    tok = F.regexp_extract(fp, r"^ *([^ ]+)", 1)
    return F.regexp_replace(tok, r"[.,;:!?]+$", "")


def embed_prompt(title: Column | str, text: Column | str) -> Column:
    """``<title> {title} <text> {text}`` (both fields stripped)."""
    t = F.coalesce(py_strip(title), F.lit(""))
    x = F.coalesce(py_strip(text), F.lit(""))
    return F.concat(F.lit("<title> "), t, F.lit(" <text> "), x)


def paragraphs(text: Column | str) -> Column:
    """Array of stripped, non-empty lines of ``text`` (order kept)."""
    c = F.col(text) if isinstance(text, str) else text
    stripped = F.transform(F.split(c, "\n"), lambda p: py_strip(p))
    return F.filter(stripped, lambda p: F.length(p) > 0)


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens used by the hashing embedder."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def hex8_to_long(hex_col: Column) -> Column:
    return F.conv(hex_col, 16, 10).cast("bigint")


def md5_bucket(s: Column, modulus: int) -> Column:
    """``int(md5(s)[:8], 16) % modulus`` as a bigint."""
    return F.pmod(hex8_to_long(F.substring(F.md5(s), 1, 8)), F.lit(modulus))
