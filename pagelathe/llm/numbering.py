"""Gapless numbers inside groups of any size, and running sums over whole tables, without one task for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.runtime import materialize

ROWS_PER_RANGE = 20_000
LEAST_RANGES = 64


def gapless(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add `name`: 0, 1, 2, ... within each `group`, in the order of `order`.

    `df` must be frozen and `order` tell its rows apart (end it with a frozen row id). Rows are dealt
    into ranges of (group, order), so a group that holds most rows covers many ranges. Each range is
    numbered by itself, and the running sums of the ranges' sizes are their first numbers; only
    those sizes are gathered by group. Null group values make a group of their own. An empty table
    stays empty.
    """
    ranges = max(LEAST_RANGES, -(-df.count() // ROWS_PER_RANGE))
    dealt = materialize(df.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    keys = [*group, "_range"]
    sizes = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_start"))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    joined = dealt.join(starts, same).drop(*[f"_of_{k}" for k in keys])
    local = Window.partitionBy(*keys).orderBy(*order)
    return joined.withColumn(name, F.col("_start") + F.row_number().over(local) - 1).drop("_start", "_range")


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add running sums over the whole table in `order`: by new name, of which column. A row's own value is in its sums.

    `df` must be frozen and `order` tell its rows apart. Rows are dealt into ranges of `order`, each summed
    by itself; only the ranges' totals, one row for ROWS_PER_RANGE, are gathered.
    """
    ranges = max(1, -(-df.count() // ROWS_PER_RANGE))
    dealt = materialize(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(F.col("_range").alias("_of_range")).agg(*[F.sum(c).alias(f"_all_{name}") for name, c in sums.items()])
    before = Window.orderBy("_of_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_of_range", *[F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in sums])
    local = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.join(starts, F.col("_range") == F.col("_of_range"))
    return joined.select(*df.columns, *[(F.col(f"_start_{name}") + F.sum(c).over(local)).alias(name) for name, c in sums.items()])
