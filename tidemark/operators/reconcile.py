"""Reconciliation of candidates with history, and integrity of a history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import effective_cumulative, normalize_header
from tidemark.operators.cadence import by_date


def with_route(rows: DataFrame, routes: DataFrame | None, **wanted: str) -> DataFrame:
    """rows with columns of their sheet's route (null without one, or where routes lack the column)."""
    if routes is None:
        return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items()})
    own = routes.select("sheet", *[(F.col(c) if c in routes.columns else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()])
    return rows.join(own, "sheet", "left")


def match_history(cand: DataFrame, hist: DataFrame, tolerance: float = 1e-6, routes: DataFrame | None = None) -> DataFrame:
    """sheet, nav_date, status (matched or conflict) of dates on both sides. Matched: unit and cumulative agree (a
    missing cumulative value is taken by the route's policy first), and so do code and name where both sides have one."""
    names = [c for c in ("code", "name") if c in cand.columns and c in hist.columns]
    h = hist.select("sheet", "nav_date", F.col("unit").alias("hu"), F.col("cumulative").alias("hc"), *[F.col(c).alias(f"h{c}") for c in names])
    rows = with_route(cand.join(h, ["sheet", "nav_date"]), routes, cumulative_policy="string", cumulative_offset="double")
    mine = effective_cumulative("unit", "cumulative", "cumulative_policy", "cumulative_offset")
    near = (F.abs(F.col("unit") - F.col("hu")) <= tolerance) & (F.coalesce(F.abs(mine - F.col("hc")), F.lit(0.0)) <= tolerance)
    same = F.lit(True)
    for c in names:
        same = same & F.coalesce(normalize_header(c) == normalize_header(f"h{c}"), F.lit(True))
    return rows.select("sheet", "nav_date", F.when(near & same, "matched").otherwise("conflict").alias("status"))


def new_rows(cand: DataFrame, hist: DataFrame) -> DataFrame:
    return cand.join(hist.select("sheet", "nav_date"), ["sheet", "nav_date"], "left_anti")


def internal_gaps(cand: DataFrame, hist: DataFrame) -> DataFrame:
    """New dates that are not after the history's last one: unsafe to fill in."""
    tail = hist.groupBy("sheet").agg(F.max("nav_date").alias("tail"))
    return new_rows(cand, hist).join(tail, "sheet").where(F.col("nav_date") <= F.col("tail")).select("sheet", "nav_date", "tail")


def period_change_check(cand: DataFrame, hist: DataFrame, max_change: float = 0.5, routes: DataFrame | None = None) -> DataFrame:
    """New dates whose value moves by more than max_change against the last known one before it. History before a
    route's series_start doesn't count. One window over history and candidates."""
    managed = with_route(hist, routes, series_start="date").where(F.col("series_start").isNull() | (F.col("nav_date") >= F.col("series_start")))
    known = managed.select("sheet", "nav_date", "unit", F.lit(False).alias("new"))
    new = new_rows(cand, hist).select("sheet", "nav_date", "unit", F.lit(True).alias("new"))
    rows = known.union(new).withColumn("previous", F.last("unit", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, -1)))
    change = F.abs(F.col("unit") / F.col("previous") - 1)
    return rows.where(F.col("new") & (change > max_change)).select("sheet", "nav_date", "unit", "previous")


def verify_boundary_anchor(pre: DataFrame, hist: DataFrame, routes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per route with baseline_overlap last_existing_point: verified if history ends the day before series_start, there is
    one candidate (unit, cumulative, code) there, it equals history's values, and its code is the route's."""
    tail = hist.groupBy("sheet").agg(F.max("nav_date").alias("tail"), F.max_by("unit", "nav_date").alias("tu"), F.max_by("cumulative", "nav_date").alias("tc"))
    r = with_route(routes.where("baseline_overlap = 'last_existing_point'").select("sheet", "series_start"), routes, code="string").withColumnRenamed("code", "expected").join(tail, "sheet", "left")
    code = F.col("code") if "code" in pre.columns else F.lit(None).cast("string")
    at = pre.select(F.col("sheet").alias("_s"), "nav_date", "unit", "cumulative", code.alias("code"))
    rows = r.join(at, (r["sheet"] == at["_s"]) & (F.date_sub("series_start", 1) == F.col("nav_date")), "left")
    near = (F.abs(F.col("unit") - F.col("tu")) <= tolerance) & (F.coalesce(F.abs(F.col("cumulative") - F.col("tc")), F.lit(0.0)) <= tolerance)
    same = F.coalesce(F.col("code") == F.col("expected"), F.lit(True))
    signature = F.struct(F.bround("unit", 10).alias("u"), F.bround("cumulative", 10).alias("c"), "code")
    per = rows.groupBy("sheet", "series_start", "tail").agg(F.count_distinct(F.when(F.col("unit").isNotNull(), F.to_json(signature))).alias("values"), F.bool_and(F.coalesce(near & same, F.lit(False))).alias("near"))
    return per.select("sheet", F.coalesce((F.col("tail") == F.date_sub("series_start", 1)) & (F.col("values") == 1) & F.col("near"), F.lit(False)).alias("verified"))


def identity_evidence(hist: DataFrame, cand: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Per sheet: evidence `code`, `name`, `both` or null.

    Both need candidates with at most one code, whose dates are in history or after it. `code`: managed history (from
    series_start on; all of it if nothing is managed yet) has exactly the route's code, and so have the candidates.
    `name`: it has exactly the route's product name, or the sheet is named so. Without routes history's own code counts."""
    h = hist if "name" in hist.columns else hist.withColumn("name", F.lit(None).cast("string"))
    h = with_route(h.withColumnRenamed("code", "hcode"), routes, series_start="date", code="string", product_name="string")
    managed = F.col("series_start").isNull() | (F.col("nav_date") >= F.col("series_start"))
    per = h.withColumn("_any", F.max(managed).over(Window.partitionBy("sheet"))).where(managed | ~F.col("_any"))
    per = per.groupBy("sheet").agg(F.count_distinct(F.nullif("hcode", F.lit(""))).alias("n"), F.min(F.nullif("hcode", F.lit(""))).alias("own"), F.first("code").alias("expected"), F.count_distinct(normalize_header("name")).alias("names"), F.min(normalize_header("name")).alias("name"), F.first(normalize_header("product_name")).alias("wanted"))
    tail = hist.groupBy("sheet").agg(F.max("nav_date").alias("tail"))
    c = cand.join(hist.select("sheet", "nav_date").distinct().withColumn("known", F.lit(True)), ["sheet", "nav_date"], "left").join(tail, "sheet", "left")
    c = c.groupBy("sheet").agg(F.count_distinct("code").alias("cn"), F.min("code").alias("cc"), F.bool_and(F.coalesce("known", F.lit(False)) | (F.col("nav_date") > F.col("tail"))).alias("safe"))
    rows = per.join(c, "sheet")
    code = (F.col("n") == 1) & F.coalesce(F.col("own") == F.coalesce("expected", "own"), F.lit(False)) & F.coalesce(F.col("cc") == F.col("own"), F.lit(True))
    name = F.coalesce((F.col("wanted") != "") & ((normalize_header("sheet") == F.col("wanted")) | ((F.col("names") == 1) & (F.col("name") == F.col("wanted")))), F.lit(False))
    given = F.when(code & name, "both").when(code, "code").when(name, "name")
    return rows.select("sheet", F.when(F.col("safe") & (F.col("cn") <= 1), given).alias("evidence"))


def verify_reserved_partial(cand: DataFrame, reserved: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """sheet, verified: a placeholder's given unit or cumulative value equals a candidate's of that date."""
    r = reserved.select("sheet", "nav_date", F.col("unit").alias("ru"), F.col("cumulative").alias("rc"))
    rows = r.join(cand, ["sheet", "nav_date"], "left")
    near = (F.col("ru").isNull() | (F.abs(F.col("unit") - F.col("ru")) <= tolerance)) & (F.col("rc").isNull() | (F.abs(F.col("cumulative") - F.col("rc")) <= tolerance))
    return rows.groupBy("sheet").agg(F.bool_or(F.coalesce(near & F.col("unit").isNotNull(), F.lit(False))).alias("verified"))


def spread_break(hist: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Complete rows whose spread of cumulative over unit differs from two neighbours that agree."""
    tol = max(tolerance * 10, 1e-8)
    rows = hist.where(F.col("unit").isNotNull() & F.col("cumulative").isNotNull()).withColumn("spread", F.col("cumulative") - F.col("unit"))
    rows = rows.withColumns({"before": F.lag("spread").over(by_date()), "after": F.lead("spread").over(by_date())})
    return rows.where((F.abs(F.col("before") - F.col("after")) <= tol) & (F.abs(F.col("spread") - F.col("before")) > tol)).select("sheet", "nav_date")


def policy_break(hist: DataFrame, spread: Column, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose spread isn't the policy's (0 for `unit`, the offset for `offset`)."""
    tol = max(tolerance * 10, 1e-8)
    return hist.where(F.abs(F.col("cumulative") - F.col("unit") - spread) > tol).select("sheet", "nav_date")


def missing_values(hist: DataFrame) -> DataFrame:
    kind = F.when(F.col("unit").isNull(), "missing-unit").when(F.col("cumulative").isNull(), "missing-cumulative")
    return hist.select("sheet", "nav_date", kind.alias("issue")).where(F.col("issue").isNotNull())


def code_constancy(hist: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows whose code isn't the route's."""
    r = routes.select("sheet", F.col("code").alias("expected"))
    return hist.where(F.coalesce("code", F.lit("")) != "").join(r, "sheet").where(F.col("code") != F.col("expected")).select("sheet", "nav_date", "code", "expected")


def history_integrity(hist: DataFrame, routes: DataFrame) -> DataFrame:
    """sheet, issue, managed, n, repair_required: issues of managed rows need repair, those before series_start only warn.
    Spreads are checked against the policy where it fixes them (unit, offset), else against their neighbours."""
    rows = with_route(hist, routes, cumulative_policy="string", cumulative_offset="double")
    fixed = F.col("cumulative_policy").isin("unit", "offset")
    spread = F.when(F.col("cumulative_policy") == "unit", 0.0).otherwise(F.col("cumulative_offset"))
    parts = [
        spread_break(rows.where(~F.coalesce(fixed, F.lit(False)))).select("sheet", "nav_date", F.lit("spread-break").alias("issue")),
        policy_break(rows.where(fixed), spread).select("sheet", "nav_date", F.lit("policy-break").alias("issue")),
        missing_values(hist).select("sheet", "nav_date", "issue"),
        code_constancy(hist, routes).select("sheet", "nav_date", F.lit("unexpected-code").alias("issue")),
    ]
    every = with_route(reduce(DataFrame.union, parts), routes, series_start="date")
    managed = F.col("series_start").isNull() | (F.col("nav_date") >= F.col("series_start"))
    return every.withColumn("managed", managed).groupBy("sheet", "issue", "managed").agg(F.count("*").alias("n")).withColumn("repair_required", F.col("managed"))


def candidate_checks(cand: DataFrame, routes: DataFrame, as_of: Column, max_future_days: int = 0) -> DataFrame:
    """sheet, nav_date, issue: dates too far ahead, codes that aren't the route's."""
    rows = cand.join(routes.select("sheet", F.col("code").alias("expected")), "sheet", "left")
    issue = F.when(F.col("nav_date") > F.date_add(as_of, max_future_days), "future-date").when(F.col("code") != F.col("expected"), "code-mismatch")
    return rows.select("sheet", "nav_date", issue.alias("issue")).where(F.col("issue").isNotNull())


def order_check(hist: DataFrame) -> DataFrame:
    """sheet, row_no, issue: a date that repeats the row before it or goes back."""
    before = F.lag("nav_date").over(Window.partitionBy("sheet").orderBy("row_no"))
    rows = hist.withColumn("before", before)
    return rows.select("sheet", "row_no", F.when(F.col("nav_date") == F.col("before"), "duplicate-date").when(F.col("nav_date") < F.col("before"), "not-ascending").alias("issue")).where(F.col("issue").isNotNull())
