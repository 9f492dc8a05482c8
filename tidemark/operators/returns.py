"""Period, benchmark and excess returns, and analytics that follow from them. One window over (sheet, nav_date) each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_week
from tidemark.operators import scans
from tidemark.operators.cadence import by_date, period_ends


def daily_return(series: DataFrame, value: str = "unit") -> DataFrame:
    return series.withColumn("daily_return", F.col(value) / F.lag(value).over(by_date()) - 1)


def weekly_return(series: DataFrame, as_of: Column, value: str = "unit") -> DataFrame:
    """weekly_return on the last row of each completed week but the first; null elsewhere. Flag, window and value share
    one exchange: the week's last row is known from the next row, and the previous end from a running last."""
    week = iso_week("nav_date")
    nxt = F.lead("nav_date").over(by_date())
    is_end = (week < iso_week(as_of)) & (nxt.isNull() | (iso_week(nxt) > week))
    rows = series.withColumn("_end", is_end)
    before = by_date().rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last(F.when(F.col("_end"), F.col(value)), ignorenulls=True).over(before)
    return rows.withColumn("weekly_return", F.when(F.col("_end"), F.col(value) / previous - 1)).drop("_end")


def total_return(series: DataFrame, frequency: str, as_of: Column, value: str = "unit") -> DataFrame:
    """sheet, total_return: last period end over the first, less one."""
    ends = period_ends(series, frequency, as_of)
    return ends.groupBy("sheet").agg((F.max_by(value, "nav_date") / F.min_by(value, "nav_date") - 1).alias("total_return"), F.count("*").alias("periods"))


def join_benchmark(periods: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark value on the exact date; no filling forward. missing marks dates without one."""
    return periods.join(benchmark, periods["nav_date"] == benchmark["bm_date"], "left").drop("bm_date").withColumn("missing", F.col("bm_value").isNull())


def level_return(periods: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Return of a benchmark level between consecutive period ends, exact dates on both sides."""
    rows = join_benchmark(periods, benchmark)
    return rows.withColumn("benchmark_return", F.col("bm_value") / F.lag("bm_value").over(by_date()) - 1)


def aligned_return(periods: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The benchmark's own return on the date."""
    return join_benchmark(periods, benchmark).withColumn("benchmark_return", F.col("bm_value"))


def excess_return(rows: DataFrame, own: str, benchmark: str = "benchmark_return") -> DataFrame:
    """Own less benchmark return where both are known."""
    return rows.withColumn("excess_return", F.col(own) - F.col(benchmark))


def compound_return(rows: DataFrame, value: str) -> DataFrame:
    """Product of (1 + r) less one; blanks count as 0."""
    return rows.groupBy("sheet").agg((F.product(1 + F.coalesce(F.col(value), F.lit(0.0))) - 1).alias("compound_return"))


def series_reset(series: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows from series_start on; with a verified last existing point the whole history counts."""
    starts = routes.select("sheet", "series_start", "baseline_overlap")
    keep = F.col("series_start").isNull() | (F.col("baseline_overlap") == "last_existing_point") | (F.col("nav_date") >= F.col("series_start"))
    return series.join(starts, "sheet", "left").where(F.coalesce(keep, F.col("nav_date") >= F.col("series_start"))).drop("series_start", "baseline_overlap")


def risk(returns: DataFrame, value: str, factor: float, risk_free: float) -> DataFrame:
    """Annualised return (mean times factor), volatility and Sharpe ratio of periodic returns."""
    per = returns.where(F.col(value).isNotNull()).groupBy("sheet").agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count("*").alias("n"))
    annual, vol = F.col("m") * factor, F.col("s") * (factor**0.5)
    return per.where("n >= 2").select("sheet", annual.alias("annualised_return"), vol.alias("volatility"), F.when(vol > 0, (annual - risk_free) / vol).alias("sharpe"))


def max_drawdown(series: DataFrame, value: str = "unit") -> DataFrame:
    """Deepest fall from a running peak, per sheet, as a number of 0 or less, and the date of the trough."""
    peak = F.max(value).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    rows = series.withColumn("fall", F.col(value) / peak - 1)
    return rows.groupBy("sheet").agg(F.min("fall").alias("max_drawdown"), F.min_by("nav_date", F.struct("fall", "nav_date")).alias("trough_date"))


def long_daily_return(series: DataFrame, value: str = "unit", days: int = 366) -> DataFrame:
    """daily_return for series that are too long for one task: value over the one before, less 1."""
    return scans.previous(series, value, "_last", days).withColumn("daily_return", F.col(value) / F.col("_last") - 1).drop("_last")


def long_max_drawdown(series: DataFrame, value: str = "unit", days: int = 366) -> DataFrame:
    """max_drawdown for series that are too long for one task."""
    rows = scans.running_max(series, value, "_peak", days).withColumn("fall", F.col(value) / F.col("_peak") - 1)
    return rows.groupBy("sheet").agg(F.min("fall").alias("max_drawdown"), F.min_by("nav_date", F.struct("fall", "nav_date")).alias("trough_date"))


def calmar(series: DataFrame, returns: DataFrame, value: str, factor: float) -> DataFrame:
    fall = max_drawdown(series)
    return risk(returns, value, factor, 0.0).join(fall, "sheet").select("sheet", F.when(F.col("max_drawdown") < 0, F.col("annualised_return") / -F.col("max_drawdown")).alias("calmar"))


def merge_benchmark_sources(primary: DataFrame, backup: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """bm_date, bm_value, provenance, differs: the backup fills only dates that the primary lacks."""
    p = primary.select("bm_date", F.col("bm_value").alias("p"))
    b = backup.select("bm_date", F.col("bm_value").alias("b"))
    both = p.join(b, "bm_date", "full_outer")
    return both.select(
        "bm_date",
        F.coalesce("p", "b").alias("bm_value"),
        F.when(F.col("p").isNotNull(), "primary").otherwise("backup").alias("provenance"),
        F.coalesce(F.abs(F.col("p") - F.col("b")) > tolerance, F.lit(False)).alias("differs"),
    )
