import pytest
from pyspark.sql import functions as F

from tessera.operators.crosslang import clean_articles, dominant_lang_clusters, lang_distribution
from tessera.operators.ranking import group_positions
from tessera.sources.corpus import merge_order_key


def test_clean_articles(spark):
    rows = [
        ("en", 1, "A", "123456789\nrest"),
        ("en", 2, "B", "1234567890"),
        ("zh", 3, "C", "一二三四五六七八九十"),
        ("en", 4, None, "long enough text"),
        ("en", 5, "   ", "long enough text"),
    ]
    df = spark.createDataFrame(rows, "lang string, idx bigint, title string, text string")
    out = {r["idx"]: r for r in clean_articles(df).collect()}
    assert sorted(out) == [2, 3, 5]
    assert out[5]["title"] == ""


def _samples(spark, counts, cluster=0):
    rows = []
    for lang, n in counts:
        rows += [(cluster, lang)] * n
    return spark.createDataFrame(rows, "cluster_id int, lang_code string")


@pytest.mark.parametrize(
    "counts,threshold,expected",
    [
        ([("en", 4)], 0.8, None),
        ([("en", 4), ("de", 1)], 0.8, ("en", 0.8)),
        ([("en", 79), ("de", 21)], 0.8, None),
        ([("en", 13), ("de", 3)], 0.8, ("en", 0.812)),
        ([("en", 1999), ("de", 501)], 0.8, None),
        ([("de", 3), ("en", 3)], 0.5, ("en", 0.5)),
    ],
)
def test_dominance(spark, counts, threshold, expected):
    dist = lang_distribution(_samples(spark, counts))
    out = dominant_lang_clusters(dist, threshold=threshold).collect()
    if expected is None:
        assert out == []
    else:
        assert (out[0]["dominant_lang"], out[0]["dominant_lang_ratio"]) == expected


def test_merge_order(spark):
    df = spark.createDataFrame([(i,) for i in [36227, 299809, 14998, 366202, 19276]], "idx bigint").withColumn(
        "lang", F.lit("en")
    )
    keyed = df.withColumn("chunk_file", merge_order_key("idx"))
    out = group_positions(keyed, ["lang"], ["chunk_file", "idx"], pos_col="p").orderBy("p").collect()
    assert [r["idx"] for r in out] == [14998, 19276, 299809, 36227, 366202]
