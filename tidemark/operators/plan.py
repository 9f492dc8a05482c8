"""Append plans: building, applying, checking and gating them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import effective_cumulative, payload_fingerprint


def build_plan(selected: DataFrame, hist: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """sheet, nav_date, unit, cumulative, action (fill, append or gap), position. New dates are appended in order; where a
    sheet has a reserved row, its earliest new date fills it; a new date not after history's end is a gap."""
    tail = hist.groupBy("sheet").agg(F.max("nav_date").alias("tail"))
    new = selected.join(hist.select("sheet", "nav_date"), ["sheet", "nav_date"], "left_anti").join(tail, "sheet", "left")
    new = new.withColumn("position", F.row_number().over(Window.partitionBy("sheet").orderBy("nav_date")))
    if reserved is not None:
        new = new.join(reserved.select("sheet", F.lit(True).alias("held")).distinct(), "sheet", "left")
    else:
        new = new.withColumn("held", F.lit(None).cast("boolean"))
    action = F.when(F.col("nav_date") <= F.col("tail"), "gap").when(F.coalesce("held", F.lit(False)) & (F.col("position") == 1), "fill").otherwise("append")
    return new.select("sheet", "nav_date", "unit", "cumulative", action.alias("action"), "position")


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("sheet").agg(F.count_if(F.col("action") == "append").alias("appended"), F.count_if(F.col("action") == "fill").alias("filled"), F.count_if(F.col("action") == "gap").alias("gaps"), F.max("nav_date").alias("last"))


def apply_plan(hist: DataFrame, plan: DataFrame, policy: Column, offset: Column) -> DataFrame:
    """History with the plan's rows, cumulative by policy where it is missing; gaps are left out. Identity columns of
    history (code, name) are filled from the sheet's last row that has them."""
    identity = [c for c in ("code", "name") if c in hist.columns]
    columns = ["sheet", "nav_date", "unit", "cumulative"]
    added = plan.where("action <> 'gap'").select("sheet", "nav_date", "unit", effective_cumulative("unit", "cumulative", policy, offset).alias("cumulative"))
    kept = hist.join(added.select("sheet", "nav_date"), ["sheet", "nav_date"], "left_anti").select(*columns, *identity)
    if identity:
        last = hist.groupBy("sheet").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("nav_date"))).alias(c) for c in identity])
        added = added.join(last, "sheet", "left")
    return kept.unionByName(added)


def validate_plan(before: DataFrame, after: DataFrame, plan: DataFrame) -> DataFrame:
    """Violations, none if the plan was applied rightly: rows that changed without being planned, planned rows that are
    missing, dates that occur twice."""
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, (F.col("b.sheet") == F.col("a.sheet")) & (F.col("b.nav_date") == F.col("a.nav_date")), "full_outer")
    same = F.col("b.unit").eqNullSafe(F.col("a.unit")) & F.col("b.cumulative").eqNullSafe(F.col("a.cumulative"))
    changed = both.where(F.col("b.sheet").isNull() | F.col("a.sheet").isNull() | ~same).select(F.coalesce("b.sheet", "a.sheet").alias("sheet"), F.coalesce("b.nav_date", "a.nav_date").alias("nav_date"))
    planned = plan.where("action <> 'gap'").select("sheet", "nav_date")
    unplanned = changed.join(planned, ["sheet", "nav_date"], "left_anti").withColumn("issue", F.lit("unplanned-change"))
    missing = planned.join(after.select("sheet", "nav_date"), ["sheet", "nav_date"], "left_anti").withColumn("issue", F.lit("planned-row-missing"))
    twice = after.groupBy("sheet", "nav_date").agg(F.count("*").alias("n")).where("n > 1").select("sheet", "nav_date", F.lit("duplicate-date").alias("issue"))
    return unplanned.unionByName(missing).unionByName(twice)


def no_change_baseline(plan: DataFrame, report: DataFrame) -> DataFrame:
    """The baseline report if the plan adds nothing, else no rows. Decided in the plan, without running it first."""
    n = plan.agg(F.count("*").alias("_planned"))
    return report.join(F.broadcast(n), F.col("_planned") == 0).drop("_planned")  # one row


def benchmark_review_gate(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Benchmark columns are blank on sheets under review; committable says whether the sheet may be written."""
    r = routes.select("sheet", F.coalesce("benchmark_review_only", F.lit(False)).alias("_review"))
    out = rows.join(r, "sheet", "left").withColumn("_review", F.coalesce("_review", F.lit(False)))
    for c in ("benchmark_return", "excess_return"):
        out = out.withColumn(c, F.when(~F.col("_review"), F.col(c)))
    return out.withColumn("committable", ~F.col("_review")).drop("_review")


def approval_gate(routes: DataFrame, approvals: DataFrame, cols: list[str]) -> DataFrame:
    """sheet, approved: the fingerprint of a route's relevant columns equals the approved one. Paused routes keep an
    approval: `paused` is no relevant column."""
    now = routes.select("sheet", payload_fingerprint(*cols).alias("fingerprint"))
    return now.join(approvals.select("sheet", F.col("fingerprint").alias("_old")), "sheet", "left").select("sheet", F.coalesce(F.col("fingerprint") == F.col("_old"), F.lit(False)).alias("approved"))


def plan_preflight(meta: DataFrame, plan: DataFrame, routes: DataFrame, now: Column) -> DataFrame:
    """Issues of a plan before it is written. meta: one row with committable, config_fp, base_fp, config_now, base_now,
    created, rows."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created")
    facts = meta.join(F.broadcast(plan.agg(F.count("*").alias("_n"))), how="cross")  # one row each
    checks = F.array(
        F.when(~F.col("committable"), F.lit("not-committable")),
        F.when(F.col("config_fp") != F.col("config_now"), F.lit("config-changed")),
        F.when(F.col("base_fp") != F.col("base_now"), F.lit("base-changed")),
        F.when(age > 24 * 3600, F.lit("plan-expired")),
        F.when(age < -300, F.lit("plan-from-the-future")),
        F.when(F.col("rows") != F.col("_n"), F.lit("row-count-differs")),
    )
    issues = facts.select(F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("issue"), F.lit(None).cast("string").alias("sheet"))
    active = routes.where(~F.coalesce("paused", F.lit(False))).select("sheet")
    foreign = plan.select("sheet").distinct().join(active, "sheet", "left_anti").select(F.lit("sheet-not-active").alias("issue"), "sheet")
    return issues.union(foreign)


def verify_written(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-9, computed: tuple[str, ...] = ()) -> DataFrame:
    """Rows that differ after writing: sheet, nav_date, issue. Columns of actual that are computed must not be null."""
    e, a = expected.alias("e"), actual.alias("a")
    rows = e.join(a, (F.col("e.sheet") == F.col("a.sheet")) & (F.col("e.nav_date") == F.col("a.nav_date")), "full_outer")
    off = lambda c: ~(F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")) | F.coalesce(F.abs(F.col(f"e.{c}") - F.col(f"a.{c}")) <= tolerance, F.lit(False)))
    issue = F.when(F.col("a.sheet").isNull(), "missing").when(F.col("e.sheet").isNull(), "unexpected").when(off("unit") | off("cumulative"), "value-differs")
    for c in computed:
        issue = issue.when(F.col(f"a.{c}").isNull(), f"{c}-missing")
    return rows.select(F.coalesce("e.sheet", "a.sheet").alias("sheet"), F.coalesce("e.nav_date", "a.nav_date").alias("nav_date"), issue.alias("issue")).where(F.col("issue").isNotNull())


def keep_newest(df: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """Retention: the newest n rows per keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def prune_older(df: DataFrame, column: str, cutoff: Column) -> DataFrame:
    return df.where(F.col(column) >= cutoff)
