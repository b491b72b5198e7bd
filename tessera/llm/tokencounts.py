"""Token totals kept up to date by signed deltas.

Totals are additive: documents and tokens by source, language and tokenizer
version. A *batch* of changes (insert, delete, revise) is turned into signed
deltas, summed per group, and committed once under its batch id:

* insert: ``+1`` document, ``+n`` tokens;
* delete: ``-1`` document, ``-n_before`` tokens;
* revise: ``n - n_before`` tokens, no document; a change of group is a delete in
  the old group and an insert in the new one.

A commit writes the batch's sums as a table of its own below the rollup's folder;
the writer's ``_SUCCESS`` mark makes it count. Committing an id again is a no-op, a
half-written batch (lost driver or executors) does not count and is overwritten
by the next try. Totals are the sum over committed batches; ``compact`` folds
them into one. A batch is at most one row per group, so the state grows with
groups and batches, never with documents, and a hot source is reduced by partial
sums before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import new_folder

GROUP = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """``source, lang, tokenizer_version, n_docs, n_tokens`` summed per group.

    ``changes``: ``op`` (insert, delete or revise, any case), the group columns,
    ``n_tokens`` (after; for inserts and revisions) and ``n_tokens_before``
    (for deletions and revisions). Null counts are 0, null group values are a
    group of their own, repeated rows count as often as they occur; another
    ``op`` (or none) raises. Other columns are ignored. Groups whose sums are
    both 0 are left out; an empty table gives no rows.
    """
    op = F.lower(F.col("op"))
    after, before = F.coalesce(F.col("n_tokens"), F.lit(0)), F.coalesce(F.col("n_tokens_before"), F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null"))))
    rows = changes.select(
        *[F.col(c).cast("string").alias(c) for c in GROUP],
        F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong.cast("int")).cast("long").alias("d"),
        F.when(op == "insert", after).when(op == "delete", -before).otherwise(after - before).cast("long").alias("t"),
    )
    return rows.groupBy(*GROUP).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")


class TokenRollup:
    """Totals below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def temporary(cls, spark: SparkSession) -> TokenRollup:
        """A rollup below the checkpoint folder, deleted when the driver ends."""
        return cls(spark, new_folder(spark, "token-rollup"))

    def _file(self, path: str):  # noqa: ANN202
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def _exists(self, path: str) -> bool:
        system, there = self._file(path)
        return system.exists(there)

    def _folder(self, batch_id: str) -> str:
        if not batch_id or any(not (c.isalnum() or c in "-_") for c in batch_id):
            raise ValueError("a batch id is letters, digits, - and _")
        return f"{self.path}/batch-{batch_id}"

    def committed(self, batch_id: str) -> bool:
        """Whether the batch counts: written to its end, by itself or in a compacted table."""
        return self._exists(f"{self._folder(batch_id)}/_SUCCESS") or batch_id in self._folded()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add the changes; False (and nothing is read) if the batch was committed before."""
        if self.committed(batch_id):
            return False
        signed_deltas(changes).write.mode("overwrite").parquet(self._folder(batch_id))
        return True

    def _tables(self) -> list[str]:
        system, there = self._file(self.path)
        if not system.exists(there):
            return []
        names = [s.getPath().getName() for s in system.listStatus(there) if s.isDirectory()]
        whole = sorted(n for n in names if self._exists(f"{self.path}/{n}/_SUCCESS"))
        # a folded table replaces what it holds: only the latest counts, and batches outside it
        folds = [n for n in whole if n.startswith("fold-")]
        held = self._folded()
        return folds[-1:] + [n for n in whole if n.startswith("batch-") and n.removeprefix("batch-") not in held]

    def _folded(self) -> set[str]:
        system, there = self._file(self.path)
        if not system.exists(there):
            return set()
        names = sorted(s.getPath().getName() for s in system.listStatus(there) if s.getPath().getName().startswith("fold-"))
        names = [n for n in names if self._exists(f"{self.path}/{n}/_SUCCESS")]
        if not names:
            return set()
        rows = self.spark.read.schema("batch_id string").parquet(f"{self.path}/{names[-1]}").where("batch_id IS NOT NULL").select("batch_id").collect()
        return {r["batch_id"] for r in rows}

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer_version, n_docs, n_tokens`` over all committed
        batches; groups that came back to nothing are left out."""
        tables = self._tables()
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{t}" for t in tables]) if tables else self.spark.createDataFrame([], SCHEMA)
        return rows.where("n_docs IS NOT NULL").groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into one table that also names them, so that
        a late repetition of a folded batch is still a no-op."""
        tables = self._tables()
        if not tables:
            return
        held = self._folded() | {t.removeprefix("batch-") for t in tables if t.startswith("batch-")}
        names = self.spark.createDataFrame([(b,) for b in sorted(held)], "batch_id string")
        number = 1 + max((int(t.removeprefix("fold-")) for t in tables if t.startswith("fold-")), default=0)
        both = self.totals().withColumn("batch_id", F.lit(None).cast("string")).unionByName(names, allowMissingColumns=True)
        both.write.mode("overwrite").parquet(f"{self.path}/fold-{number:08d}")


def count_words(text_col: str = "text") -> F.Column:  # type: ignore[name-defined]
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
