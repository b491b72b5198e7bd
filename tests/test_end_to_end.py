import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tessera.plans.end_to_end import run_all_stages, write_stages
from tessera.sources.corpus import load_corpus


def test_all_stages_end_to_end(spark):
    corpus = load_corpus(spark, SF_SMALL)
    res = run_all_stages(corpus, k_multi=20, max_iter=20)
    n_docs = corpus.count()
    # stage 1: routes partition the non-blank input
    routes = res.records.groupBy("selected").count().collect()
    assert sum(r["count"] for r in routes) <= n_docs
    # stage 2: every selected article in exactly one cluster; ids cover range(k)
    sel = res.records.where("selected").count()
    assert res.clusters.where(F.col("idx").isNotNull()).count() == sel
    # stage 3: top + rest = all clusters; top count = floor(0.2 n) per language
    sc = res.cluster_scores.toPandas()
    for lang, part in sc.groupby("lang"):
        assert int(part["is_top"].sum()) == int(len(part) * 0.2)
    assert (res.top_texts.groupBy("lang", "cluster_id").count().where("count > 10").count()) == 0
    # stage 4: dominated clusters meet the rule
    for r in res.dominated.collect():
        assert r["sample_count"] >= 5 and r["ratio"] >= 0.8
    out = tempfile.mkdtemp(prefix="tessera-stages-")
    write_stages(res, out)
    assert os.path.isdir(os.path.join(out, "ner", "selected"))
    back = spark.read.parquet(os.path.join(out, "cluster_quality"))
    assert back.count() == len(sc)


def test_pool_from_top_texts_and_outlier_option(spark):
    corpus = load_corpus(spark, SF_SMALL)
    res = run_all_stages(corpus, k_multi=10, max_iter=10, pool_from="top_texts", drop_outliers=True)
    top = {(r["lang"], r["idx"]) for r in res.top_texts.join(res.cluster_scores.where("is_top"), ["lang", "cluster_id"]).collect()}
    pooled = {(r["lang_code"], r["idx"]) for r in res.pool.collect()}
    assert pooled <= top
    assert res.samples.count() <= res.pool.count()


def test_each_text_meets_the_models_once(spark):
    """A counting recogniser and embedder, through every stage and every sink."""
    import uuid

    from tessera.operators.embed import HashingEmbedder

    folder = tempfile.mkdtemp(prefix="tessera-count-")

    def note(kind, texts):
        with open(os.path.join(folder, f"{kind}-{uuid.uuid4().hex}"), "w") as f:
            f.write(str(len(texts)))

    def total(kind):
        return sum(int(open(os.path.join(folder, f)).read()) for f in os.listdir(folder) if f.startswith(kind))

    def recognise(lang, texts):
        note("ner", texts)
        return [[(t.split(" ")[0].strip(".,;:!?"), "ORG")] if t else [] for t in texts]

    class Counting(HashingEmbedder):
        def encode(self, texts):
            note("embed", texts)
            return super().encode(texts)

    corpus = load_corpus(spark, SF_SMALL)
    res = run_all_stages(corpus, embedder=Counting(), recognizer=recognise, k_multi=5, max_iter=5)
    write_stages(res, os.path.join(folder, "out"))
    assert total("ner") == res.records.count()
    chosen = res.records.where("selected").count()
    # stage 2 prompts, stage 3 texts, stage 3 paragraphs of kept texts, stage 4 prompts
    from tessera.functions.text import paragraphs

    kept = res.quality.candidates.select("lang", "idx").join(corpus.select("lang", "idx", F.size(paragraphs("text")).alias("m")), ["lang", "idx"])
    inner = kept.where("m > 1").agg(F.sum("m")).first()[0] or 0
    assert total("embed") == 2 * chosen + inner + res.pool.count()


def test_quality_parts_run_when_asked_for(spark):
    from tessera.plans.quality_selection import score_clusters

    class Refusing:
        def encode(self, texts):
            raise AssertionError("entropy must not run for the distances")

    v = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").selectExpr("vec_id AS idx", "label AS cluster_id", "CAST(embedding AS array<double>) AS vec")
    corpus = load_corpus(spark, SF_SMALL)
    q = score_clusters(corpus.select("lang", "idx", "title").join(v, "idx"), corpus, vec_col="vec", embedder=Refusing())
    assert q.members.count() > 0


def test_cap_is_opt_in_and_per_language(spark):
    from tessera.plans.ner_selection import run_ner_selection

    rows = [(lang, i, "Wien", "Wien ist schön") for lang in ("de", "en") for i in range(1000, 1010)] + [(None, 1, "Wien", "Wien ist schön")]
    corpus = spark.createDataFrame(rows, "lang string, idx bigint, title string, text string")
    assert run_ner_selection(corpus).count() == 21
    capped = {(r["lang_code"], r["index"]) for r in run_ner_selection(corpus, cap=3).collect()}
    assert capped == {(lang, i) for lang in ("de", "en") for i in (1000, 1001, 1002)} | {(None, 1)}


def test_empty_pool_gives_empty_results(spark):
    from tessera.plans.multi_lang import cluster_records, run_multi_lang

    pool = spark.createDataFrame([], "lang_code string, idx bigint, title string, text string, sel_pos bigint")
    samples, dist, dominated = run_multi_lang(pool)
    assert samples.count() == dist.count() == dominated.count() == cluster_records(samples, dist, 10).count() == 0
