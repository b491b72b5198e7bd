"""Exact in-group positions and medians that survive a hot group.

``row_number() OVER (PARTITION BY g ORDER BY ...)`` sends every row of a group
to one task. When one group may hold a third of all rows that is not
acceptable, so positions are computed the way a distributed sort does it:

1. range-partition on ``(group, order...)`` - the sampler splits a hot group
   over many partitions - and sort inside partitions;
2. number rows inside each partition with ``monotonically_increasing_id``
   (consecutive within a partition);
3. per ``(partition, group)`` keep the first id and the row count - a table
   with at most ``#groups + #partitions`` rows - and turn the counts into
   offsets with a window whose partitions hold at most ``#partitions`` rows;
4. join the offsets back: ``pos = offset + id - first_id``.

The sorted frame is written once, so both uses see the very same partitioning
even if an executor is lost in between. There is one path, whatever the size of
a group, and a null group is a group like any other.

Order statistics (medians) need no sort at all, see ``group_quantiles``.

Top-*k* with a *constant* ``k`` does not need this: Spark plans
``row_number() <= k`` with a partial ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bits of a double that each round of a histogram leaves for the next ones: 22, 21 and 21 are looked at.
HISTOGRAM_SHIFTS = (42, 21, 0)


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on group keys in which a null key matches a null key; the left keys stay."""
    other = right.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = functools.reduce(lambda x, y: x & y, [left[k].eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    return left.join(other, same, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def group_positions(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    pos_col: str = "pos",
    size_col: str | None = "group_size",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add the exact 0-based position of each row inside its group.

    ``order_cols`` must make the order total (end it with a unique key) so
    positions are deterministic. Adds ``size_col`` (rows in the group) too.
    """
    n_parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _as_cols(group_cols) + _as_cols(order_cols)
    ordered = (
        df.repartitionByRange(n_parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    ordered = cut_lineage(ordered)
    g = list(group_cols)
    per_part = ordered.groupBy("_pid", *g).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = per_part.select(
        "_pid",
        *g,
        "_first",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(whole).alias("_gsize"),
    )
    out = join_groups(ordered, offsets, ["_pid", *g]).withColumn(
        pos_col, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint")
    )
    if size_col:
        out = out.withColumn(size_col, F.col("_gsize").cast("bigint"))
    return out.drop("_pid", "_mid", "_first", "_off", "_gsize")


def ordered_bits(value: Column) -> Column:
    """A long that sorts like the double: its bits, those of negative numbers turned round
    (-0.0 counts as 0.0; NaN is the greatest)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + 0.0).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def double_of(bits: Column) -> Column:
    """The double that :func:`ordered_bits` gave ``bits`` for."""
    plain = F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), plain).cast("double")


def group_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str, ranks: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """``(group..., which, value)``: exact order statistics of every group; ``ranks`` turn the number
    of values into 0-based positions (as in ``floor((n - 1) / 2)``), ``which`` numbers them.

    No sort: in each of ``len(HISTOGRAM_SHIFTS)`` rounds the values that can still be the wanted one
    are counted by some more leading bits, for all groups at once and combined before
    the shuffle, and the bin that holds the position is kept. A group is at most
    ``2 ** 22`` counts in one task, whatever its size. Null values do not count; a
    group without any is absent.
    """
    g = list(group_cols)
    rows = df.where(F.col(value_col).isNotNull()).select(*g, ordered_bits(F.col(value_col)).alias("_bits"))
    state: DataFrame | None = None
    for shift in HISTOGRAM_SHIFTS:
        prefix = F.shiftright("_bits", shift).alias("_prefix")
        if state is None:
            bins = rows.groupBy(*g, prefix).agg(F.count(F.lit(1)).alias("_n"))
            total = F.sum("_n").over(Window.partitionBy(*g))
            wanted = F.array(*[F.struct(F.lit(i).alias("which"), rank(F.col("_total")).cast("long").alias("rank")) for i, rank in enumerate(ranks)])
            bins = bins.withColumn("_total", total).select(*g, "_prefix", "_n", F.explode(wanted).alias("_w")).select(*g, "_prefix", "_n", F.col("_w.which").alias("_which"), F.col("_w.rank").alias("_rank"))
        else:
            at = state.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(g)], "_which", "_rank", F.col("_prefix").alias("_at"))
            same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(g)], F.shiftright("_bits", last) == F.col("_at"))
            bins = rows.join(at, same).groupBy(*g, "_which", "_rank", prefix).agg(F.count(F.lit(1)).alias("_n"))
        below = F.coalesce(F.sum("_n").over(Window.partitionBy(*g, "_which").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = bins.withColumn("_below", below).where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_n")))
        state, last = held.select(*g, "_which", (F.col("_rank") - F.col("_below")).alias("_rank"), "_prefix"), shift
    return state.select(*g, F.col("_which").alias("which"), double_of(F.col("_prefix")).alias("value"))


def group_median(
    df: DataFrame, group_cols: Sequence[str], value_col: str, key_col: str, out_col: str = "median"
) -> DataFrame:
    """Exact median of ``value_col`` per group (mean of the two middle values).

    Same definition as ``numpy.median`` over the values that are not null; a
    group without any has a null median. ``key_col`` says nothing (equal values are one).
    """
    g = list(group_cols)
    middle = group_quantiles(df, g, value_col, [lambda n: F.floor((n - 1) / 2), lambda n: F.floor(n / 2)])
    medians = middle.groupBy(*g).agg(F.avg("value").alias(out_col))
    groups = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return join_groups(groups, medians, g, "left")
