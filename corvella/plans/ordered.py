"""Ranks and running totals over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvella.plans.storage import materialise


def running_totals(rows: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with a running sum per entry of ``sums`` in the order of ``order``, which must tell rows apart.

    Rows are dealt over ranges of the order and written once; sums of whole ranges (one row per partition) are
    added to the running sums inside each range.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    base = totals.select("_range", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.join(F.broadcast(base), "_range")  # one row per partition
    return both.select(*rows.columns, *[(F.sum(c).over(inside) + F.col(f"_{name}")).alias(name) for name, c in sums.items()])


def cume_dist(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the share of rows whose ``value`` is at most theirs."""
    kept = materialise(rows, "cume-dist")
    n = running_totals(kept.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), [value], {"_upto": F.col("_n")}).withColumnRenamed(value, "_value")
    total = kept.agg(F.count(F.lit(1)).alias("_total"))
    both = kept.join(n, F.col(value).eqNullSafe(F.col("_value"))).join(F.broadcast(total))  # one row
    return both.select(*kept.columns, (F.col("_upto") / F.col("_total")).alias(name))
