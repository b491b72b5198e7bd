"""Queries of this subpackage: one ``opN_<name>`` per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, collisions, convrepair, decontam, hmm, imatch, langid, licenses, linededup, neardup, tokenalign, urlfilter
from tessera.llm.tokencounts import TokenRollup, count_words
from tessera.llm.scratch import store
from tessera.llm.sql import SQL
from tessera.operators.ranking import join_groups
from tessera.session import table_path

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


@register
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from ids outside bucket 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.crc_bucket(F.col("doc_id"), 5) != 0))
    return langid.score(docs, model).select("doc_id", (langid.crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@register
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents, the second committed twice.

    ``load`` inserts every document under two tokenizer versions (white-space
    words; runs of ASCII letters and digits or other non-ASCII characters).
    ``repeats`` revises the first version's counts to what is left when a
    document's repeated lines count once. ``blank`` deletes documents without a
    word under either version.
    """
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("source", "lang", text.alias("text"))
    counted = docs.select(
        "source",
        "lang",
        count_words().alias("words"),
        F.regexp_count("text", F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+")).cast("long").alias("runs"),
        F.regexp_count(F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("once"),
    )
    versions = F.explode(F.array(F.struct(F.lit("words-1").alias("tokenizer_version"), F.col("words").alias("n")), F.struct(F.lit("runs-1").alias("tokenizer_version"), F.col("runs").alias("n"))))
    both = counted.select("source", "lang", "words", "runs", versions.alias("v")).select("source", "lang", "words", "runs", "v.*")
    none = F.lit(None).cast("long")
    load = both.select(F.lit("insert").alias("op"), "source", "lang", "tokenizer_version", F.col("n").alias("n_tokens"), none.alias("n_tokens_before"))
    repeats = counted.where("once <> words").select(F.lit("revise").alias("op"), "source", "lang", F.lit("words-1").alias("tokenizer_version"), F.col("once").alias("n_tokens"), F.col("words").alias("n_tokens_before"))
    blank = both.where("words = 0 OR runs = 0").select(F.lit("delete").alias("op"), "source", "lang", "tokenizer_version", none.alias("n_tokens"), F.col("n").alias("n_tokens_before"))
    rollup = TokenRollup.temporary(spark)
    rollup.commit("load", load)
    rollup.commit("repeats", repeats)
    rollup.commit("repeats", repeats)
    rollup.commit("blank", blank)
    rollup.compact()
    return rollup.totals()


@register
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    marked = decontam.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register
def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and likeness to the next."""
    docs = table(spark, sf_dir, "documents")
    return imatch.compared_with_next(docs, imatch.build_lexicon(docs))


@register
def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@register
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page URL: the rules', else the models' on the whole URL."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


@register
def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document under the model learned from ids outside remainder 2 of 7."""
    docs = table(spark, sf_dir, "documents")
    return hmm.score(docs, langid.crc_bucket(F.col("doc_id"), 7) == 2)


@register
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    coded = bpe.encode_texts(table(spark, sf_dir, "documents"), pack=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document: base phrases and rules."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base, more = F.col("base.label"), F.col("detections.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, more)).alias("labels"),
        # sure of any label: one minus the chance that all evidence is mistaken
        F.round(1 - F.aggregate(F.concat(F.transform("base", lambda _: F.lit(0.9)), F.col("detections.confidence")), F.lit(1.0), lambda acc, c: acc * (1 - c)), 9).alias("score"),
        F.col("detections.rule").alias("rules"),
    )


@register
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: removed lines and digest of the text left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = linededup.without_lines(docs, linededup.repeated_lines(docs))
    return left.select("row.doc_id", "exact_lines", "near_lines", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@register
def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all others."""
    return collisions.search_nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


@register
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under both vocabularies."""
    return tokenalign.link_counts(table(spark, sf_dir, "documents"))


@register
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after seeded damage."""
    given = table(spark, sf_dir, "conversations")
    turns = store(convrepair.damage(given), "damaged-turns")
    repairs, repaired = convrepair.repair(turns)
    every = given.select(F.col("conv_id").alias("conv")).distinct()
    found = join_groups(join_groups(every, repairs, ["conv"], "left"), convrepair.digests(repaired), ["conv"], "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        F.col("conv").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
