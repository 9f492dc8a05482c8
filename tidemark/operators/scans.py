"""Prefix scans over long series in two passes: a series is cut into blocks of time, each block gives an associative
summary (its last value, its greatest value), the summaries are scanned (one row per block), and every block then goes
on from what stands before it. No task holds more than a block of a series, however long the series is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_blocks(series: DataFrame, days: int, order: str = "nav_date") -> DataFrame:
    """series with _block: the number of the stretch of so many days that a row's date or time falls into."""
    return series.withColumn("_block", F.floor(F.col(order).cast("timestamp").cast("long") / (days * 86_400)))


def carried(series: DataFrame, summary: Column, over: Column, days: int, key: str = "sheet", order: str = "nav_date") -> DataFrame:
    """series with _block and _before: `over` of the summaries (_s) of all blocks of the series before the row's own; null
    for the first one."""
    rows = with_blocks(series, days, order)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "_block").agg(summary.alias("_s")).select(F.col(key).alias("_key"), F.col("_block").alias("_of"), over.over(before).alias("_before"))
    return rows.join(blocks, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of"))).drop("_key", "_of")


def previous(series: DataFrame, value: str, name: str, days: int = 366, key: str = "sheet", order: str = "nav_date") -> DataFrame:
    """series with the value of the row before, as lag() over the whole series gives it."""
    last = F.max_by(F.struct(F.col(value).alias("v")), order)  # the struct keeps a null that stands last
    rows = carried(series, last, F.last("_s"), days, key, order)
    own = Window.partitionBy(key, "_block").orderBy(order)
    first = F.row_number().over(own) == 1
    return rows.withColumn(name, F.when(first, F.col("_before.v")).otherwise(F.lag(value).over(own))).drop("_block", "_before")


def running_max(series: DataFrame, value: str, name: str, days: int = 366, key: str = "sheet", order: str = "nav_date") -> DataFrame:
    """series with the greatest value up to the row."""
    rows = carried(series, F.max(value), F.max("_s"), days, key, order)
    own = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.greatest("_before", F.max(value).over(own))).drop("_block", "_before")
