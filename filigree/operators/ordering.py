"""Ranks and running sums over groups of any size.

A window partitioned by a hot key sorts that key's rows in one task. Here rows
are range-partitioned by (group, order), so that a hot group spreads over many
tasks; each task numbers its slice, and the slices' totals, a table with one
row per slice and group, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import cut

_PID = "__slice"
_SUM = "__slice_sum"
_BEFORE = "__before"


def running_sum(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    value: Column,
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group's rows up to this one.

    ``order`` must be total within a group for the result to be determined; ties
    get an arbitrary order among themselves. Null group keys form a group of
    their own. An empty input gives an empty output with the same columns.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut(
        df.withColumn(_SUM, value)
        .repartitionByRange(n, *[F.col(c) for c in group], *order)
        .withColumn(_PID, F.spark_partition_id())
    )
    totals = sliced.groupBy(*group, _PID).agg(F.sum(_SUM).alias("__total"))
    earlier = Window.partitionBy(*group).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)],
        F.col(_PID).alias("__p"),
        F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias(_BEFORE),
    )
    within = Window.partitionBy(_PID, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = sliced.withColumn("__within", F.sum(_SUM).over(within))
    same = F.col(_PID) == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return numbered.join(offsets, same, "left").select(
        *[F.col(c) for c in df.columns], (F.col("__within") + F.col(_BEFORE)).alias(name)
    )


def row_numbers(
    df: DataFrame, group: list[str], order: list[Column], name: str, partitions: int | None = None
) -> DataFrame:
    """``row_number`` per group without a task that holds a whole group."""
    return running_sum(df, group, order, F.lit(1).cast("long"), name, partitions)


def places(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: 1 plus the number of the group's rows with a larger ``value``.

    Null and NaN stand behind every number and share one place. Rows are first
    counted by (group, value), so a value that repeats a million times travels as
    one row.
    """
    clean = F.when(F.isnan(F.col(value)), F.lit(None)).otherwise(F.col(value))
    rows = df.withColumn("__v", clean)
    counts = rows.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__c"))
    summed = running_sum(counts, group, [F.col("__v").desc_nulls_last()], F.col("__c"), "__upto")
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(group)]
    lookup = summed.select(
        *keys, F.col("__v").alias("__lv"), (F.col("__upto") - F.col("__c") + 1).alias(name)
    )
    same = F.col("__v").eqNullSafe(F.col("__lv"))
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(lookup, same, "left").select(*[F.col(c) for c in df.columns], F.col(name))
