"""One whole update run: approved routes only, reconciled, planned, checked, published and verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cadence, plan, reconcile
from tidemark.sources import snapshots


def validated(cand: DataFrame, hist: DataFrame, routes: DataFrame, as_of: Column, max_change: float) -> DataFrame:
    """sheet, error: the first check that a sheet's candidates or history fail: an unapproved route, a candidate of
    another code or too far ahead, a conflict with history, a change too large, a gap that can't be filled."""
    errors = [
        (0, "not-approved", cand.select("sheet").distinct().join(routes.where("approved").select("sheet"), "sheet", "left_anti")),
        (1, "candidate", reconcile.candidate_checks(cand, routes, as_of).select("sheet")),
        (2, "conflict", reconcile.match_history(cand, hist, routes=routes).where("status = 'conflict'").select("sheet")),
        (3, "period-change", reconcile.period_change_check(cand, hist, max_change, routes).select("sheet")),
        (4, "internal-gap", reconcile.internal_gaps(cand, hist).select("sheet")),
    ]
    found = None
    for order, name, rows in errors:
        rows = rows.select("sheet", F.struct(F.lit(order).alias("order"), F.lit(name).alias("error")).alias("e"))
        found = rows if found is None else found.union(rows)
    return found.groupBy("sheet").agg(F.min("e").alias("e")).select("sheet", "e.error")


def run_update(spark: SparkSession, base: str, cand: DataFrame, routes: DataFrame, as_of: Column, max_change: float = 0.5, keep: int = 3) -> DataFrame:
    """sheet, error, added per sheet of the candidates, after the published table at `base` has been brought up to date.

    Sheets that fail `validated` are skipped as a whole. Of the others, candidates are selected by the sheet's cadence,
    planned and applied; the result is checked against the plan before it is published. Where nothing is added, nothing
    is published, so a rerun changes nothing. routes: sheet, code, approved, series_start, cumulative_policy,
    cumulative_offset."""
    fingerprint = snapshots.current_fingerprint(spark, base)
    hist = snapshots.read_published(spark, base)
    failed = validated(cand, hist, routes, as_of, max_change)
    errors = snapshots.stored(failed, "update-errors")
    sound = cand.join(errors, "sheet", "left_anti")
    chosen = cadence.select_for_frequency(sound, hist, cadence.infer_frequency(hist), as_of)
    made = snapshots.stored(plan.build_plan(reconcile.with_route(chosen, routes, cumulative_policy="string", cumulative_offset="double").withColumn("cumulative", reconcile.effective_cumulative("unit", "cumulative", "cumulative_policy", "cumulative_offset")), hist), "update-plan")
    if not made.where("action <> 'gap'").isEmpty():
        after = plan.apply_plan(hist, made, F.lit("require"), F.lit(0.0))
        columns = ["sheet", "nav_date", "unit", "cumulative"]
        if not plan.validate_plan(hist.select(*columns), after.select(*columns), made).isEmpty():
            raise ValueError("the result isn't what was planned")
        snapshots.publish_version(after, base, fingerprint, keep)
    added = made.where("action <> 'gap'").groupBy("sheet").agg(F.count("*").alias("added"))
    sheets = cand.select("sheet").distinct()
    return sheets.join(errors, "sheet", "left").join(added, "sheet", "left").select("sheet", "error", F.coalesce("added", F.lit(0)).cast("long").alias("added"))
