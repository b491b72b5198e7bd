"""Entity annotation and title-entity selection (stage 1).

The built-in recogniser is model-free and deterministic: spans are runs of
capitalised words (Han/Katakana runs for zh/ja) found by ``regexp_extract_all``;
each span gets a label picked by ``md5(span)`` from the language's label
palette. It is expressed with built-in column functions only, so the whole
selection stage stays inside whole-stage codegen. A real NER model plugs in
through ``annotate_entities(..., recognizer=...)`` (``mapInPandas``, model
loaded once per Python worker).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    ONTONOTES_LANGS,
    STANDIN_LABELS_ONTONOTES,
    STANDIN_LABELS_OTHER,
    SUPPORTED_LANGS,
    VALID_LABELS_ONTONOTES,
    VALID_LABELS_OTHER,
    valid_labels_for,
)
from ..functions.text import (
    CAPITALISED_RUN_PATTERN,
    CJK_RUN_PATTERN_JAVA,
    first_paragraph,
    is_blank,
    md5_bucket,
    py_strip,
    title_is_valid,
)

ENTITY_TYPE = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])
)


def _str_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _is_ontonotes(lang: Column) -> Column:
    return lang.isin(ONTONOTES_LANGS)


def valid_labels_col(lang: Column | str) -> Column:
    lc = F.col(lang) if isinstance(lang, str) else lang
    return F.when(_is_ontonotes(lc), _str_array(VALID_LABELS_ONTONOTES)).otherwise(_str_array(VALID_LABELS_OTHER))


def valid_labels_table(spark) -> DataFrame:
    """``(lang, label)`` for every supported language (a fixed, tiny table)."""
    rows = [(lang, label) for lang in SUPPORTED_LANGS for label in valid_labels_for(lang)]
    return spark.createDataFrame(rows, "lang string, label string")


def builtin_entities(text: Column | str, lang: Column | str) -> Column:
    """``array<struct<text, label>>`` from the built-in recogniser."""
    t = F.col(text) if isinstance(text, str) else text
    lc = F.col(lang) if isinstance(lang, str) else lang
    latin = F.regexp_extract_all(t, F.lit(CAPITALISED_RUN_PATTERN), 0)
    cjk = F.regexp_extract_all(t, F.lit(CJK_RUN_PATTERN_JAVA), 0)
    spans = F.when(lc.isin("zh", "ja"), cjk).otherwise(latin)
    onto = _str_array(STANDIN_LABELS_ONTONOTES)
    other = _str_array(STANDIN_LABELS_OTHER)

    def to_entity(s: Column) -> Column:
        label = F.when(
            _is_ontonotes(lc), F.element_at(onto, (md5_bucket(s, len(STANDIN_LABELS_ONTONOTES)) + 1).cast("int"))
        ).otherwise(F.element_at(other, (md5_bucket(s, len(STANDIN_LABELS_OTHER)) + 1).cast("int")))
        return F.struct(py_strip(s).alias("text"), label.alias("label"))

    return F.transform(spans, to_entity)


def annotate_entities(
    df: DataFrame,
    text_col: str = "ner_text",
    lang_col: str = "lang",
    recognizer: Callable[[str, list[str]], list[list[tuple[str, str]]]] | None = None,
    out_col: str = "entities",
) -> DataFrame:
    """Add ``out_col`` with the entities of ``text_col``.

    ``recognizer(lang, texts) -> [[(text, label), ...], ...]`` is a model
    plug-in run by ``mapInPandas``; ``None`` uses the built-in recogniser. Rows
    of a null language are passed with ``None``; a result count that differs
    from the number of texts is an error.
    """
    if recognizer is None:
        return df.withColumn(out_col, builtin_entities(text_col, lang_col))

    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, ENTITY_TYPE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ents: list = [None] * len(pdf)
            pdf = pdf.reset_index(drop=True)
            for lang, part in pdf.groupby(lang_col, sort=False, dropna=False):
                found = recognizer(None if pd.isna(lang) else lang, part[text_col].fillna("").tolist())
                if len(found) != len(part):
                    raise ValueError(f"the recogniser returned {len(found)} results for {len(part)} texts")
                for pos, e in zip(part.index, found, strict=True):
                    ents[pos] = [{"text": t.strip(), "label": lab} for t, lab in e]
            yield pdf.assign(**{out_col: ents})

    return df.mapInPandas(run, schema)


class SpacyRecognizer:
    """Optional model plug-in: ``recognizer(lang, texts)`` backed by spaCy.

    One pipeline per language, loaded lazily once per Python worker and reused
    across batches. ``models`` maps a language to a pipeline name. spaCy is not
    installed in this environment; the class only fails when called.
    """

    def __init__(self, models: dict[str, str], batch_size: int = 64):
        self.models = dict(models)
        self.batch_size = batch_size
        self._nlp: dict = {}

    def _pipeline(self, lang: str):
        if lang not in self._nlp:
            try:
                import spacy  # type: ignore
            except ImportError as e:  # pragma: no cover - optional dependency
                raise RuntimeError("spaCy is not installed") from e
            if lang not in self.models:
                raise ValueError(f"no pipeline is named for language {lang!r}")
            self._nlp[lang] = spacy.load(self.models[lang])
        return self._nlp[lang]

    def __call__(self, lang: str, texts: list[str]) -> list[list[tuple[str, str]]]:
        nlp = self._pipeline(lang)
        return [[(e.text, e.label_) for e in doc.ents] for doc in nlp.pipe(texts, batch_size=self.batch_size)]


def title_entity_overlap(entities: Column | str, title: Column | str, lang: Column | str) -> Column:
    """Some non-empty entity with a valid label is inside the title, or contains it (case-sensitive)."""
    ents = F.col(entities) if isinstance(entities, str) else entities
    t = F.col(title) if isinstance(title, str) else title
    valid = valid_labels_col(lang)
    return F.exists(
        ents,
        lambda e: (F.length(e["text"]) > 0)
        & F.array_contains(valid, e["label"])
        & (t.contains(e["text"]) | e["text"].contains(t)),
    )


def selection_flag(corpus: DataFrame, out_col: str = "selected") -> DataFrame:
    """Add the stage-1 routing flag to every corpus row (built-in recogniser).

    Pure column expressions, so any per-row analysis can carry the flag
    without a join; blank rows are never selected.
    """
    fp = first_paragraph("text")
    with_ents = corpus.withColumn("_ents", builtin_entities(py_strip(fp), "lang"))
    flag = (
        ~is_blank("title")
        & ~is_blank(fp)
        & title_is_valid("title")
        & title_entity_overlap("_ents", "title", "lang")
        & (F.size("_ents") > 0)
    )
    return with_ents.withColumn(out_col, F.coalesce(flag, F.lit(False))).drop("_ents")


def ner_records(corpus: DataFrame, recognizer=None, keep_first_paragraph: bool = False) -> DataFrame:
    """Stage-1 records for every non-blank article, with the routing flag.

    Output: ``lang_code, index, title, entities, title_valid, has_overlap, selected``
    (plus ``first_paragraph`` when asked, so a later stage in the same plan
    needs no join back to the corpus). Rows whose stripped title or first
    paragraph is empty (or null title) are in neither route.
    """
    base = corpus.select(
        "lang", "idx", "title", first_paragraph("text").alias("_fp")
    ).where(~is_blank("title") & ~is_blank("_fp"))
    base = base.withColumn("ner_text", py_strip("_fp"))
    annotated = annotate_entities(base, "ner_text", "lang", recognizer)
    valid = title_is_valid("title")
    overlap = title_entity_overlap("entities", "title", "lang")
    return annotated.select(
        F.col("lang").alias("lang_code"),
        F.col("idx").alias("index"),
        "title",
        "entities",
        valid.alias("title_valid"),
        F.coalesce(valid & overlap, F.lit(False)).alias("has_overlap"),
        F.coalesce(valid & overlap & (F.size("entities") > 0), F.lit(False)).alias("selected"),
        *([F.col("_fp").alias("first_paragraph")] if keep_first_paragraph else []),
    )


def entity_string(entities: Column | str) -> Column:
    """Flat, comparable rendering ``text/label|text/label``."""
    ents = F.col(entities) if isinstance(entities, str) else entities
    return F.array_join(F.transform(ents, lambda e: F.concat(e["text"], F.lit("/"), e["label"])), "|")
