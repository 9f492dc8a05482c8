"""Cadence of a series: frequency, weekly selection and period ends. Series are keyed by sheet and ordered by nav_date;
consecutive operators share that one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import iso_week


def by_date(key: str = "sheet") -> Window:
    return Window.partitionBy(key).orderBy("nav_date")


def infer_frequency(hist: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """sheet, dates, median_gap, frequency (daily, weekly, or null where the gaps prove neither), source; with settings
    (sheet, configured: auto, daily or weekly; hint: the frequency that the sheet's return header names) also issue:
    `unprovable`, or `disagrees` where another frequency is configured.

    Two dates or more: the median gap decides, up to 4 days daily, up to 10 weekly; else weekly if at least 70 % of the
    gaps have five days or more and are within a day of whole weeks. With one date only the hint counts, daily without
    one."""
    days = hist.select("sheet", "nav_date").distinct()
    gap = F.date_diff("nav_date", F.lag("nav_date").over(by_date()))
    gaps = days.withColumn("gap", gap)
    near_week = (F.col("gap") >= 5) & (F.least(F.col("gap") % 7, (7 - F.col("gap") % 7) % 7) <= 1)
    per = gaps.groupBy("sheet").agg(F.count("*").alias("dates"), F.median("gap").alias("median_gap"), F.avg(F.when(F.col("gap").isNotNull(), near_week.cast("int"))).alias("near"))
    kind = F.when(F.col("dates") < 2, "daily").when(F.col("median_gap") <= 4, "daily").when(F.col("median_gap") <= 10, "weekly").when(F.col("near") >= 0.7, "weekly")
    found = per.select("sheet", "dates", "median_gap", kind.alias("frequency"), F.when(F.col("dates") < 2, "email-source").otherwise("history").alias("source"))
    if settings is None:
        return found
    rows = found.join(settings.select("sheet", "configured", "hint"), "sheet", "left")
    short = F.col("dates") < 2
    kind = F.when(short, F.coalesce("hint", F.lit("daily"))).otherwise(F.col("frequency"))
    source = F.when(short & F.col("hint").isNotNull(), "header").otherwise(F.col("source"))
    issue = F.when(kind.isNull(), "unprovable").when((F.coalesce("configured", F.lit("auto")) != "auto") & (F.col("configured") != kind), "disagrees")
    return rows.select("sheet", "dates", "median_gap", kind.alias("frequency"), source.alias("source"), issue.alias("issue"))


def gap_histogram(dates: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """sheet, gap, n: how often each gap of days between neighbouring dates occurs, and a row with a null gap that holds
    the first and last date and their number (first, last, n). With `after` (an earlier histogram) only dates behind its
    last ones count, and the gaps go on from these."""
    days = dates.select("sheet", "nav_date").distinct()
    if after is not None:
        ends = after.where("gap is null").select("sheet", F.col("last").alias("_last"))
        days = days.join(ends, "sheet", "left").where(F.col("_last").isNull() | (F.col("nav_date") > F.col("_last")))
    else:
        days = days.withColumn("_last", F.lit(None).cast("date"))
    gaps = days.withColumn("gap", F.date_diff("nav_date", F.coalesce(F.lag("nav_date").over(by_date()), "_last")).cast("long"))
    counted = gaps.where("gap is not null").groupBy("sheet", "gap").agg(F.count("*").alias("n"), F.lit(None).cast("date").alias("first"), F.lit(None).cast("date").alias("last"))
    spans = gaps.groupBy("sheet").agg(F.lit(None).cast("long").alias("gap"), F.count("*").alias("n"), F.min("nav_date").alias("first"), F.max("nav_date").alias("last"))
    return counted.unionByName(spans)


def merged_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two histograms of stretches that follow one another (b was made after a) as one. Nothing of the history is read."""
    return a.unionByName(b).groupBy("sheet", "gap").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def frequency_of(histogram: DataFrame) -> DataFrame:
    """What infer_frequency gives for the history, from its histogram: the median is exact."""
    gaps = histogram.where("gap is not null")
    upto = F.sum("n").over(Window.partitionBy("sheet").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    ranked = gaps.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy("sheet"))})
    middle = lambda k: F.min(F.when(F.col("upto") >= k, F.col("gap")))
    near_week = (F.col("gap") >= 5) & (F.least(F.col("gap") % 7, (7 - F.col("gap") % 7) % 7) <= 1)
    per = ranked.groupBy("sheet").agg(
        ((middle(F.floor((F.col("total") + 1) / 2)) + middle(F.floor(F.col("total") / 2) + 1)) / 2).alias("median_gap"),
        (F.sum(F.when(near_week, F.col("n")).otherwise(0)) / F.sum("n")).alias("near"),
    )
    rows = histogram.where("gap is null").select("sheet", F.col("n").alias("dates")).join(per, "sheet", "left")
    kind = F.when(F.col("dates") < 2, "daily").when(F.col("median_gap") <= 4, "daily").when(F.col("median_gap") <= 10, "weekly").when(F.col("near") >= 0.7, "weekly")
    return rows.select("sheet", "dates", "median_gap", kind.alias("frequency"), F.when(F.col("dates") < 2, "email-source").otherwise("history").alias("source"))


def preferred_weekday(hist: DataFrame) -> DataFrame:
    """sheet, weekday (Monday is 0): the most frequent one, among equals the one seen last."""
    per = hist.groupBy("sheet", F.weekday("nav_date").alias("weekday")).agg(F.countDistinct("nav_date").alias("n"), F.max("nav_date").alias("last"))
    return per.groupBy("sheet").agg(F.max_by("weekday", F.struct("n", "last")).alias("weekday"))


def select_weekly(cand: DataFrame, hist: DataFrame, as_of: Column) -> DataFrame:
    """Candidates that a weekly series takes. Per week: dates that history has already; else nothing from the current
    week on; else the last on or before the preferred weekday, or the first of the week if there is none; without a
    preferred weekday the last."""
    known = hist.select("sheet", "nav_date").distinct().withColumn("known", F.lit(True))
    rows = cand.join(known, ["sheet", "nav_date"], "left").join(preferred_weekday(hist), "sheet", "left").withColumn("week", iso_week("nav_date"))
    week = Window.partitionBy("sheet", "week")
    early = F.weekday("nav_date") <= F.col("weekday")
    rows = rows.withColumns(
        {
            "any_known": F.max(F.coalesce("known", F.lit(False))).over(week),
            "last_early": F.max(F.when(early, F.col("nav_date"))).over(week),
            "first": F.min("nav_date").over(week),
            "last": F.max("nav_date").over(week),
        }
    )
    chosen = F.when(F.col("weekday").isNull(), F.col("last")).otherwise(F.coalesce("last_early", "first"))
    keep = F.when(F.col("any_known"), F.coalesce("known", F.lit(False))).when(F.col("week") >= iso_week(as_of), False).otherwise(F.col("nav_date") == chosen)
    return rows.where(keep).select(*cand.columns)


def select_for_frequency(cand: DataFrame, hist: DataFrame, frequency: DataFrame, as_of: Column) -> DataFrame:
    """Daily series keep all candidates, weekly ones those of select_weekly; series without a frequency keep none."""
    kinds = frequency.select("sheet", "frequency")
    daily = cand.join(kinds.where("frequency = 'daily'").select("sheet"), "sheet", "left_semi")
    weekly = select_weekly(cand.join(kinds.where("frequency = 'weekly'").select("sheet"), "sheet", "left_semi"), hist, as_of)
    return daily.unionByName(weekly)


def withheld_current_week(cand: DataFrame, hist: DataFrame, as_of: Column) -> DataFrame:
    """Candidate dates after the history's end, in the current week and not after as_of, that weekly selection holds
    back."""
    tail = hist.groupBy("sheet").agg(F.max("nav_date").alias("tail"))
    taken = select_weekly(cand, hist, as_of).select("sheet", "nav_date")
    rows = cand.select("sheet", "nav_date").distinct().join(tail, "sheet")
    rows = rows.where((F.col("nav_date") > F.col("tail")) & (iso_week("nav_date") == iso_week(as_of)) & (F.col("nav_date") <= as_of))
    return rows.join(taken, ["sheet", "nav_date"], "left_anti").select("sheet", "nav_date")


def pending_week_baseline(cand: DataFrame, hist: DataFrame, as_of: DataFrame) -> DataFrame:
    """sheet, pending: nothing can be added yet, rightly. There are new candidates, and all of them are in as_of's week and
    not after it; every other candidate is in history; history isn't stale; history has one code, which all candidates
    have; history is complete. as_of: sheet, as_of, max_staleness_days."""
    complete = F.col("unit").isNotNull() & F.col("cumulative").isNotNull()
    h = hist.groupBy("sheet").agg(F.max("nav_date").alias("tail"), F.min("code").alias("hcode"), F.count_distinct("code").alias("codes"), F.bool_and(complete).alias("full"))
    known = hist.select("sheet", "nav_date").distinct().withColumn("known", F.lit(True))
    rows = cand.join(known, ["sheet", "nav_date"], "left").join(h, "sheet").join(as_of, "sheet")
    new = F.col("known").isNull()
    inside = (F.col("nav_date") > F.col("tail")) & (iso_week("nav_date") == iso_week("as_of")) & (F.col("nav_date") <= F.col("as_of"))
    per = rows.groupBy("sheet").agg(
        F.count_if(new).alias("n"),
        F.bool_and(~new | inside).alias("inside"),
        F.bool_and(F.coalesce((F.col("code") == F.col("hcode")) & (F.col("codes") == 1), F.lit(False))).alias("same"),
        F.first("full").alias("full"),
        F.first(F.date_diff("as_of", "tail") <= F.col("max_staleness_days")).alias("fresh"),
    )
    return per.select("sheet", ((F.col("n") > 0) & F.col("inside") & F.col("same") & F.col("full") & F.col("fresh")).alias("pending"))


def period_ends(series: DataFrame, frequency: str, as_of: Column) -> DataFrame:
    """Daily: every date. Weekly: the last date of each completed week."""
    if frequency == "daily":
        return series
    week = Window.partitionBy("sheet", iso_week("nav_date")).orderBy(F.desc("nav_date"))
    ends = series.where(iso_week("nav_date") < iso_week(as_of)).withColumn("_rank", F.row_number().over(week))
    return ends.where("_rank = 1").drop("_rank")
