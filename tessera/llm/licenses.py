"""Licence scan by ordered signature rules.

Per text: an Aho-Corasick pass over the keywords of all rules, and over the words that
their patterns cannot do without (a licence's own name before all), tells which
rules can match at all; only those regular expressions run, on the normalised text.
Their detections are ordered by priority, then length, then place, and one
that lies inside the word interval of a better one is suppressed (so "GNU Lesser
General Public License" is not also the plain one). Independently, the
*base phrases* are counted at every place where their words stand in a row.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from re import _parser

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import ALNUM, Words, chunks, flat
from tessera.llm.license_rules import Rule, rules
from tessera.llm.scratch import map_batches, schema_with

#: Base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Word parts shorter than this are in too many texts to tell anything.
SHORTEST = 3

FOUND = "n_words long, base array<struct<label:string,first:long>>, detections array<struct<rule:string,label:string,confidence:double,first:long,last:long>>"


def needed(pattern: str) -> list[frozenset[str]]:
    """Sets of word parts, one of each of which is in every match of a pattern."""

    def sets(tree) -> list[frozenset[str]]:  # noqa: ANN001
        out, run = [], ""
        for kind, arg in [*((str(k), a) for k, a in tree), ("END", None)]:
            if kind == "LITERAL" and (chr(arg).isascii() and chr(arg).isalnum()):
                run += chr(arg)
                continue
            before, run = run, ""
            if before:
                out.append(frozenset([before]))
            if kind == "BRANCH":
                # the parser takes a common start out of the ways: it belongs to each of them
                ways = [best([*(("LITERAL", ord(c)) for c in before), *x]) for x in arg[1]]
                if all(ways):
                    out.append(frozenset().union(*ways))
            elif kind == "SUBPATTERN":
                out += sets(arg[3])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                out += sets(arg[2])
        return out

    def best(tree) -> frozenset[str]:  # noqa: ANN001
        return max(sets(tree), key=lambda c: min(map(len, c)), default=frozenset())

    return [c for c in sets(_parser.parse(pattern)) if min(map(len, c)) >= SHORTEST]


class Scanner:
    """Rules compiled once per worker, by keyword."""

    def __init__(self, every: list[Rule]) -> None:
        self.rules = every
        self.needed = [needed(r.pattern) for r in every]
        self.patterns = [regex.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in every]
        self.by_keyword: dict[str, list[int]] = {}
        for k, r in enumerate(every):
            self.by_keyword.setdefault(r.keyword, []).append(k)
        self.last_words = {p.split()[-1] for p, _ in BASE}
        self.gate = ahocorasick.Automaton()
        for keyword in {*self.by_keyword, *(p.split()[-1] for p, _ in BASE), *(w for clauses in self.needed for c in clauses for w in c)}:
            self.gate.add_word(keyword, keyword)
        self.gate.make_automaton()

    def keywords(self, lowered: str) -> set[str]:
        return {k for _, k in self.gate.iter(lowered)}

    def opens(self, keywords: set[str]) -> bool:
        """Whether anything can be found: the last word of a base phrase is there, or all that some rule needs."""
        if not keywords.isdisjoint(self.last_words):
            return True
        return any(not any(c.isdisjoint(keywords) for c in self.needed[k]) for key in keywords & self.by_keyword.keys() for k in self.by_keyword[key])

    @staticmethod
    def spaces(text: str) -> list[int]:
        """Places of the spaces: the number before a place is the number of its word."""
        return [m.start() for m in regex.finditer(" ", text)]

    def base(self, text: str, spaces: list[int]) -> list[tuple[str, int]]:
        """``(label, first word)`` of every place of a base phrase, in order of place."""
        out = []
        padded = f" {text} "
        for phrase, label in BASE:
            at = padded.find(f" {phrase} ")
            while at >= 0:
                out.append((label, bisect.bisect_left(spaces, at)))
                at = padded.find(f" {phrase} ", at + 1)
        return sorted(out, key=lambda x: (x[1], x[0]))

    def candidates(self, text: str, spaces: list[int], keywords: set[str]) -> list[tuple[int, int, int]]:
        """``(rule, first word, last word)`` of every match of a gated rule."""
        out = []
        for keyword in sorted(keywords & self.by_keyword.keys()):
            for k in self.by_keyword[keyword]:
                if any(c.isdisjoint(keywords) for c in self.needed[k]):
                    continue
                out += [(k, bisect.bisect_left(spaces, m.start()), bisect.bisect_left(spaces, m.end() - 1)) for m in self.patterns[k].finditer(text)]
        return out

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Detections left after suppression, by place. A detection goes if its
        interval lies inside that of a better one; equal intervals keep the
        better rule (higher priority, then earlier in the list).

        ``reach`` is a Fenwick tree over the distinct first words: the furthest
        last word of a kept interval that starts no later.
        """
        starts = sorted({a for _, a, _ in found})
        reach = [-1] * (len(starts) + 1)
        kept = []
        for k, a, b in sorted(found, key=lambda x: (-self.rules[x[0]].priority, x[1] - x[2], x[1], x[0])):
            at = here = bisect.bisect_left(starts, a) + 1
            furthest = -1
            while here:
                furthest = max(furthest, reach[here])
                here &= here - 1
            if furthest >= b:
                continue
            kept.append((k, a, b))
            while at < len(reach):
                reach[at] = max(reach[at], b)
                at += at & -at
        return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, base, detections`` of every whole text.

    ``base``: every place of a base phrase (label, first word); ``detections``:
    rule, label, confidence and word interval, after suppression, by place.
    Word numbers count from 0. Null or empty text: no words, nothing found. A
    row per input row (repeats and null ids included); other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner()
        for batch in batches:
            body, offsets = flat(batch.column(1))
            for i, j in chunks(offsets):
                words = Words(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                raw, cut, first = words.data.tobytes(), (offsets[i : j + 1] - offsets[i]).tolist(), words.first.tolist()
                base: list[list[dict]] = []
                detections: list[list[dict]] = []
                for k in range(j - i):
                    keywords = own.keywords(raw[cut[k] : cut[k + 1]].decode("utf-8", "replace"))
                    if not own.opens(keywords):
                        base.append([])
                        detections.append([])
                        continue
                    text = words.text(first[k], first[k + 1]).decode("utf-8", "replace")
                    spaces = own.spaces(text)
                    base.append([{"label": label, "first": at} for label, at in own.base(text, spaces)])
                    detections.append(
                        [
                            {"rule": r.name, "label": r.label, "confidence": r.confidence, "first": a, "last": b}
                            for r, a, b in ((own.rules[n], a, b) for n, a, b in own.resolve(own.candidates(text, spaces, keywords)))
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(words.count, pa.int64()),
                        pa.array(base, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))),
                        pa.array(detections, pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("confidence", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))),
                    ],
                    names=["id", "n_words", "base", "detections"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, run, schema_with(docs.schema[id_col].dataType, FOUND)).withColumnRenamed("id", id_col)
