"""Report data: per-language sample, 2-D PCA, language shares, source comparison.

These feed the charts of the original workflow (the charts themselves are not
rebuilt). Semantics here are our own.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scaling import column_stats


def sample_per_lang(df: DataFrame, n: int, seed: int = 42, lang_col: str = "lang", id_col: str = "idx") -> DataFrame:
    """Exactly ``min(n, rows)`` rows per language, repeatable.

    Rows are ordered by ``md5(seed || ':' || id)``; ``row_number() <= n`` is
    planned with a partial window-group limit, so no language is shipped whole.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    w = Window.partitionBy(lang_col).orderBy(key, F.col(id_col))
    return df.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def pca_2d(df: DataFrame, vec_col: str, dim: int, out_prefix: str = "pc") -> DataFrame:
    """Project centred vectors on the first two principal components.

    MLlib's ``PCAModel.transform`` does not subtract the mean, so the input is
    centred first. Each component's sign is fixed so its largest-magnitude
    loading is positive.
    """
    means, _ = column_stats(df, vec_col, dim)
    m_arr = F.array(*[F.lit(float(m)) for m in means])
    centred = df.withColumn("_c", array_to_vector(F.transform(F.col(vec_col), lambda x, i: x.cast("double") - F.element_at(m_arr, i + 1))))
    model = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred)
    pc = model.pc.toArray()
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = model.transform(centred).withColumn("_pa", vector_to_array("_p"))
    return out.withColumn(f"{out_prefix}1", F.col("_pa")[0] * signs[0]).withColumn(
        f"{out_prefix}2", F.col("_pa")[1] * signs[1]
    ).drop("_c", "_p", "_pa")


def lang_share(df: DataFrame, lang_col: str = "lang") -> DataFrame:
    """``(lang, n, share)``; the total comes from the tiny per-language table."""
    per = df.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def source_comparison(raw: DataFrame, selected: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Language shares of two sources side by side (full outer join on language)."""
    a = lang_share(raw, lang_col).select(lang_col, F.col("n").alias("raw_n"), F.col("share").alias("raw_share"))
    b = lang_share(selected, lang_col).select(
        lang_col, F.col("n").alias("selected_n"), F.col("share").alias("selected_share")
    )
    j = a.join(b, lang_col, "full")
    return j.select(
        lang_col,
        F.coalesce("raw_n", F.lit(0)).cast("bigint").alias("raw_n"),
        F.coalesce("selected_n", F.lit(0)).cast("bigint").alias("selected_n"),
        F.coalesce("raw_share", F.lit(0.0)).alias("raw_share"),
        F.coalesce("selected_share", F.lit(0.0)).alias("selected_share"),
    )


def source_centroid_shift(df: DataFrame, vec_col: str, flag_col: str, dim: int | None = None, lang_col: str = "lang") -> DataFrame:
    """Per language: cosine distance between the mean vector of all rows and of
    the flagged (selected) rows - one grouped aggregation with two vector
    means (``Summarizer``; the selected mean weights rows by the 0/1 flag)."""
    from pyspark.ml.stat import Summarizer

    from ..functions.vectors import cosine_distance

    feats = df.select(
        lang_col,
        array_to_vector(F.col(vec_col).cast("array<double>")).alias("_f"),
        F.col(flag_col).cast("double").alias("_w"),
    )
    per = feats.groupBy(lang_col).agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.sum("_w").cast("bigint").alias("n_selected"),
        Summarizer.mean(F.col("_f")).alias("_raw"),
        Summarizer.mean(F.col("_f"), F.col("_w")).alias("_sel"),
    )
    return per.select(
        lang_col,
        "n_raw",
        F.coalesce("n_selected", F.lit(0)).cast("bigint").alias("n_selected"),
        F.when(
            F.col("n_selected") > 0, cosine_distance(vector_to_array("_raw"), vector_to_array("_sel"))
        ).alias("centroid_distance"),
    )


def flagged_source_comparison(df: DataFrame, flag_col: str, lang_col: str = "lang") -> DataFrame:
    """``source_comparison`` for a selection given as a flag column: one pass.

    Counts of all rows and of flagged rows per language come from a single
    aggregation; shares are taken over that per-language table.
    """
    per = df.groupBy(lang_col).agg(
        F.count(F.lit(1)).alias("raw_n"), F.sum(F.col(flag_col).cast("long")).alias("selected_n")
    )
    everything = Window.partitionBy()
    return per.select(
        lang_col,
        F.col("raw_n").cast("bigint").alias("raw_n"),
        F.coalesce("selected_n", F.lit(0)).cast("bigint").alias("selected_n"),
        F.try_divide(F.col("raw_n"), F.sum("raw_n").over(everything)).alias("raw_share"),
        F.coalesce(F.try_divide(F.col("selected_n"), F.sum("selected_n").over(everything)), F.lit(0.0)).alias(
            "selected_share"
        ),
    )
