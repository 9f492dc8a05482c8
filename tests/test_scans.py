"""Long series in blocks: the values of one window over the whole series; histograms of gaps kept up to date."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import cadence, scans

D0 = dt.date(2020, 1, 1)


def series(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(s, D0 + dt.timedelta(days=d), r.choice([None, r.uniform(1, 9)]) if r.random() < 0.2 else r.uniform(1, 9)) for s in ("a", "b", None) for d in sorted(r.sample(range(2000), n))]
    return spark.createDataFrame(rows, "sheet string, nav_date date, unit double").repartition(5)


def test_scans_equal_one_window(spark):
    df = series(spark)
    w = Window.partitionBy("sheet").orderBy("nav_date")
    want = df.withColumns({"last": F.lag("unit").over(w), "peak": F.max("unit").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    for days in (1, 30, 5000):
        got = scans.running_max(scans.previous(df, "unit", "last", days), "unit", "peak", days).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), days
    empty = df.where("false")
    assert scans.previous(empty, "unit", "last").count() == 0


def test_one_long_series_spreads_over_tasks(spark):
    rows = spark.range(0, 1_000_000, numPartitions=8).select(F.lit("s").alias("sheet"), F.timestamp_seconds(F.col("id") * 3600).alias("nav_date"), (F.col("id") % 1000 + 1.0).alias("unit"))
    got = scans.previous(rows, "unit", "last", days=400).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("unit") - F.col("last")).alias("d")).collect()
    assert max(r.n for r in got) < 700_000 and len(got) > 1
    assert sum(r.d for r in got) == (999_999 % 1000 + 1) - 1


def test_histograms_equal_the_whole_history(spark):
    df = series(spark, 150, 3).where("sheet is not null").select("sheet", "nav_date").union(spark.createDataFrame([("one", D0)], "sheet string, nav_date date"))
    want = {tuple(r) for r in cadence.infer_frequency(df).collect()}
    assert {tuple(r) for r in cadence.frequency_of(cadence.gap_histogram(df)).collect()} == want
    cuts = [D0, D0 + dt.timedelta(days=300), D0 + dt.timedelta(days=301), D0 + dt.timedelta(days=1500), D0 + dt.timedelta(days=3000)]
    state = None
    for least, most in zip(cuts, cuts[1:], strict=False):
        new = df.where((F.col("nav_date") >= F.lit(least)) & (F.col("nav_date") <= F.lit(most)))
        more = cadence.gap_histogram(new, state)
        state = more if state is None else cadence.merged_histograms(state, more)
    assert {tuple(r) for r in cadence.frequency_of(state).collect()} == want
