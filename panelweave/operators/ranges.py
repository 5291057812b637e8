"""Running counts over ordered values, without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.plans.storage import durable


def in_ranges(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """counts cut into ranges of (keys, order) that are about equally long, so a group may span many of them; ``__range`` numbers them.

    The cut is written, so that a lost executor cannot move it between its uses.
    """
    return durable(counts.repartitionByRange(*keys, order).withColumn("__range", F.spark_partition_id()), "ranges")


def placed(counts: DataFrame, keys: list[str], order: str, n: str = "n") -> DataFrame:
    """counts, one row a group and value of order, with ``below`` and ``above``: sums of n over its smaller and larger values.

    Sums inside a range need one task a range, and what lies before and after it
    comes from sums a group and range. counts may be cut by in_ranges() already.
    Keys are not null; a null value of order comes first.
    """
    cut = counts if "__range" in counts.columns else in_ranges(counts, keys, order)
    earlier = Window.unboundedPreceding, -1
    sums = cut.groupBy(*keys, "__range").agg(F.sum(n).alias("__n"))
    group = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("__n").over(group.orderBy("__range").rowsBetween(*earlier)), F.lit(0))
    around = sums.select(*keys, "__range", ahead.alias("__ahead"), F.sum("__n").over(group).alias("__all"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(*earlier)), F.lit(0))
    met = cut.withColumn("__inside", inside).join(around, [*keys, "__range"])
    met = met.withColumn("below", F.col("__ahead") + F.col("__inside"))
    return met.withColumn("above", F.col("__all") - F.col("below") - F.col(n)).drop("__range", "__ahead", "__inside", "__all")


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n) over the rows with a value."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def middle_values(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, low, high) per group of value counts: both middle values of the sorted ones, the same one twice where n is odd."""
    size = F.col("below") + F.col("n") + F.col("above")
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value)))
    return placed(counts, keys, value).groupBy(*keys).agg(F.max(size).alias("n"), at(F.floor((size - 1) / 2)).alias("low"), at(F.floor(size / 2)).alias("high"))


def midpoint(low: Column, high: Column) -> Column:
    return 0.5 * low + 0.5 * high
