"""Small cases of the series engine with expected rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import audit, cadence, extract, filters, layout, plan, quality, reconcile, reports, resolve, returns, routing
from tidemark.sources import snapshots

D = dt.date


def day(y, m, d):
    return F.lit(f"{y}-{m:02d}-{d:02d}").cast("date")


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_parse_number_and_date(spark):
    cases = [("1,234.5", 1234.5), ("1，234", 1234.0), ("5%", None), ("1e3", None), ("-1", None), ("0", None), ("1000000", None), ("abc", None), (None, None)]
    got = spark.createDataFrame([(c,) for c, _ in cases], "c string").select("c", S.parse_number("c").alias("n")).collect()
    assert [(r["c"], r["n"]) for r in got] == cases
    dates = [("2026-1-9", D(2026, 1, 9)), ("2026年1月9日", D(2026, 1, 9)), ("20260109", D(2026, 1, 9)), ("260109", D(2026, 1, 9)), ("800101", D(1980, 1, 1)), ("46031", D(2026, 1, 9)), ("2026-02-30", None), ("soon", None)]
    got = spark.createDataFrame([(c,) for c, _ in dates], "c string").select("c", S.parse_date("c").alias("d")).collect()
    assert [(r["c"], r["d"]) for r in got] == dates


def test_delimited_text(spark):
    text = "Dear all\nProduct Code | NAV Date | Unit NAV | Cumulative NAV\nDEMO01 | 2026-01-09 | 1.01 | 1.01\nend"
    got = extract.extract_delimited(spark.createDataFrame([(1, text), (2, None), (3, "")], "message_id long, plain string"), "message_id", "plain")
    assert values(got, "message_id", "code", "nav_date", "unit", "cumulative") == [(1, "DEMO01", D(2026, 1, 9), 1.01, 1.01)]
    two = "NAV Date | Valuation Date | Unit NAV\n2026-01-09 | 2026-01-09 | 1.01"
    assert extract.extract_delimited(spark.createDataFrame([(1, two)], "message_id long, plain string"), "message_id", "plain").count() == 0


def test_html_spans(spark):
    page = (
        "<table><tr><th rowspan=2>Product Code</th><th rowspan=2>NAV Date</th><th colspan=2>NAV</th></tr><tr><th>Unit NAV</th><th>Cumulative NAV</th></tr>"
        "<tr><td><span>DEMO</span>&nbsp;01</td><td rowspan=2>2026-01-09</td><td>1.01</td><td>1.02</td></tr><tr><td>OTHER01</td><td>2.01</td><td>2.02</td></tr></table>"
    )
    df = spark.createDataFrame([(1, page), (2, page.replace("rowspan=2", "rowspan=0")), (3, None)], "message_id long, html string")
    got = extract.extract_html_tables(df, "message_id", "html")
    assert values(got, "message_id", "code", "unit", "cumulative") == [(1, "DEMO01", 1.01, 1.02), (1, "OTHER01", 2.01, 2.02)]


def observations(spark, rows):
    return spark.createDataFrame([("s", D(2026, 1, 9), u, None, "m" + str(uid), uid, c, uid) for uid, u, c in rows], "sheet string, nav_date date, unit double, cumulative double, message_id string, uid long, correction boolean, event_id long")


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(100, 1.10, False), (101, 1.11, True)], [1.11]),  # a later correction wins
        ([(100, 1.10, False), (102, 1.12, False)], []),  # a plain late value conflicts
        ([(99, 1.11, True), (100, 1.10, False)], []),  # an early correction doesn't win
    ],
)
def test_corrections(spark, rows, expected):
    obs = resolve.apply_corrections(observations(spark, rows))
    assert [r["unit"] for r in resolve.resolve_same_day(obs).collect()] == expected


def test_ambiguous_correction(spark):
    obs = observations(spark, [(100, 1.10, False)]).union(observations(spark, [(101, 1.11, True)])).union(observations(spark, [(101, 1.12, True)]))
    assert resolve.correction_winners(obs).count() == 0 and resolve.date_conflicts(obs).count() == 1


def test_integrity(spark):
    rows = [("s", D(2026, 1, 2 + 7 * i), u, c, code) for i, (u, c, code) in enumerate([(1.0, 1.5, "DEMO01"), (1.1, 1.1, "DEMO02"), (1.2, 1.7, "DEMO03")])]
    hist = spark.createDataFrame(rows, "sheet string, nav_date date, unit double, cumulative double, code string")
    routes = spark.createDataFrame([("s", "DEMO01", None)], "sheet string, code string, series_start date")
    assert values(reconcile.history_integrity(hist, routes), "issue", "n") == [("spread-break", 1), ("unexpected-code", 2)]


def test_weekly_reduction(spark):
    hist = spark.createDataFrame([("s", D(2026, 1, 2)), ("s", D(2026, 1, 9))], "sheet string, nav_date date").withColumn("unit", F.lit(1.0))
    cand = spark.createDataFrame([("s", D(2026, 1, 2) + dt.timedelta(days=i)) for i in range(22) if (D(2026, 1, 2) + dt.timedelta(days=i)).weekday() < 5], "sheet string, nav_date date").withColumn("unit", F.lit(1.0))
    kind = cadence.infer_frequency(hist)
    assert values(kind, "frequency") == [("weekly",)]
    picked = cadence.select_for_frequency(cand, hist, kind, day(2026, 1, 28))
    assert values(reconcile.new_rows(picked, hist), "nav_date") == [(D(2026, 1, 16),), (D(2026, 1, 23),)]


def test_level_benchmark(spark):
    fridays = [D(2026, 1, 2) + dt.timedelta(days=7 * i) for i in range(4)]
    periods = spark.createDataFrame([("s", d, 1.0 + i / 100) for i, d in enumerate(fridays)], "sheet string, nav_date date, unit double")
    levels = spark.createDataFrame([(d, 100.0 + i) for i, d in enumerate(fridays)], "bm_date date, bm_value double")
    got = {r["nav_date"]: r["benchmark_return"] for r in returns.level_return(periods, levels).collect()}
    assert got[fridays[0]] is None and got[fridays[2]] == pytest.approx(102 / 101 - 1)
    total = returns.total_return(periods, "weekly", day(2026, 2, 15)).first()["total_return"]
    assert total == pytest.approx(1.03 - 1)


def test_weekly_return_of_an_unfinished_week(spark):
    rows = spark.createDataFrame([("s", D(2026, 1, 2), 1.0), ("s", D(2026, 1, 9), 1.1), ("s", D(2026, 1, 14), 1.2)], "sheet string, nav_date date, unit double")
    got = {r["nav_date"].day: r["weekly_return"] for r in returns.weekly_return(rows, day(2026, 1, 15)).collect()}
    assert got[2] is None and got[9] == pytest.approx(0.1) and got[14] is None


def test_boundary_anchor(spark):
    hist = spark.createDataFrame([("s", D(2026, 1, 2), 1.0, 1.0), ("s", D(2026, 1, 9), 1.01, 1.01)], "sheet string, nav_date date, unit double, cumulative double")
    routes = spark.createDataFrame([("s", D(2026, 1, 10), "last_existing_point")], "sheet string, series_start date, baseline_overlap string")
    for unit, ok in ((1.01, True), (1.02, False)):
        pre = spark.createDataFrame([("s", D(2026, 1, 9), unit, unit)], "sheet string, nav_date date, unit double, cumulative double")
        assert reconcile.verify_boundary_anchor(pre, hist, routes).first()["verified"] is ok


def test_plan_is_idempotent(spark):
    hist = spark.createDataFrame([("s", D(2026, 1, 2), 1.0, 1.5)], "sheet string, nav_date date, unit double, cumulative double")
    cand = spark.createDataFrame([("s", D(2026, 1, 9), 1.1, 1.6)], "sheet string, nav_date date, unit double, cumulative double")
    made = plan.build_plan(cand, hist)
    after = plan.apply_plan(hist, made, F.lit("require"), F.lit(0.0))
    assert after.count() == 2 and plan.build_plan(cand, after).count() == 0
    assert plan.validate_plan(hist, after, made).count() == 0 and plan.verify_written(after, after).count() == 0


def test_alias_and_routing(spark):
    routes = spark.createDataFrame([("sheet", "a@example.com", "NEW002", None, None, None, False)], "sheet string, sender string, code string, code_aliases array<string>, paused boolean, series_start date, allow_sender_only boolean")
    cands = spark.createDataFrame([("a@example.com", "NEW002A")], "sender string, code string")
    assert values(routing.alias_pending(cands, routes), "code", "route_code") == [("NEW002A", "NEW002")]
    obs = cands.withColumns({"nav_date": day(2026, 1, 9), "unit": F.lit(1.0), "message_id": F.lit("m")})
    stored = routes.withColumn("code_aliases", F.array(F.lit("NEW002A")))
    assert values(routing.route_observations(obs, routes), "outcome") == [("unconfigured",)]
    assert values(routing.route_observations(obs, stored), "outcome", "sheet", "code") == [("routed", "sheet", "NEW002")]
    bare = obs.withColumn("code", F.lit(None).cast("string"))
    assert values(routing.route_observations(bare, stored), "outcome") == [("error",)]


def test_categories(spark):
    s = spark.createDataFrame([("Quarterly report",), ("Quarterly report with NAV",), ("Estimated NAV",), ("NAV at virtual meeting",)], "s string")
    assert [r[0] for r in s.select(filters.non_nav_category(F.col("s"))).collect()] == ["periodic-report", None, "virtual-estimate", None]


def test_layout(spark):
    head = ["NAV Date", "Fund Return", "Product Name", "Unit NAV", "Product Code", "Cumulative NAV"]
    body = [["2026-01-02", "", "Demo Fund", "1.0", "DEMO01", "1.0"], ["2026-01-09", "", "Demo Fund", "1.01", "DEMO01", "1.01"], ["TOTAL"]]
    cells = spark.createDataFrame([("Demo Fund", r + 1, c + 1, v, "value") for r, row in enumerate([head, *body]) for c, v in enumerate(row) if v], "sheet string, row int, col int, value string, kind string")
    found = layout.detect_layout(cells)
    assert found.first()["header_row"] == 1
    hist = layout.cells_to_history(cells, found)
    assert values(hist, "nav_date", "unit") == [(D(2026, 1, 2), 1.0), (D(2026, 1, 9), 1.01)]
    assert values(layout.find_total_row(cells, hist), "total_row", "placed") == [(4, True)]


def test_validation_branches(spark):
    base = {"mode": "summary", "matches": 0, "conflicts": 0, "selected": 1, "reserved": False, "pending_week": False, "boundary": False, "managed": 1, "onboarding": False, "errors": 0}
    cases = [({"reserved": True}, "reserved-row", True), ({"mode": "template"}, "template", True), ({"pending_week": True}, "pending-week", True), ({"boundary": True, "managed": 0}, "boundary-baseline", True), ({"onboarding": True}, "reviewed-onboarding", True), ({}, "short-history", False), ({"mode": "append"}, "short-history", True), ({"matches": 2}, "strict", True), ({"matches": 2, "conflicts": 1}, "strict", False)]
    df = spark.createDataFrame([(str(i), *(base | c).values()) for i, (c, _, _) in enumerate(cases)], ["sheet", *base])
    got = {r["sheet"]: (r["branch"], r["passes"]) for r in reports.validation_report(df).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [(b, p) for _, b, p in cases]


def test_options_and_audit(spark):
    options = spark.createDataFrame([("tolerance", 0.0), ("max_future_days", 9.0), ("zero_threshold", 0.05)], "option string, value double")
    assert values(quality.option_bounds(options), "option") == [("max_future_days",), ("tolerance",)]
    text = "see C:\\Users\\me\\x\npassword = 'abcdefgh1'\nmail me@corp.test or a@example.com\nfine"
    got = audit.audit_text(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")
    assert values(got, "line", "category") == [(1, "absolute-user-path"), (2, "credential-literal"), (3, "non-example-email")]


def test_publish_and_snapshot(spark):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    base = snapshots.fresh_path(spark, "t")
    assert snapshots.publish_version(df, base, None, 2) == 1
    with pytest.raises(ValueError):
        snapshots.publish_version(df, base, "something else", 2)
    more = df.union(df)
    assert snapshots.publish_version(more, base, snapshots.current_fingerprint(spark, base), 2) == 2
    assert snapshots.read_published(spark, base).count() == 2
    path = snapshots.save_snapshot(df, "c", "s", True)
    assert snapshots.load_snapshot(spark, path, "c", "s").count() == 1
    with pytest.raises(ValueError):
        snapshots.load_snapshot(spark, path, "c", "other")


def test_order_does_not_matter(spark):
    obs = observations(spark, [(100, 1.10, False), (101, 1.11, True)])
    a = resolve.apply_corrections(obs).collect()
    assert a == resolve.apply_corrections(obs.orderBy(F.desc("uid")).repartition(3)).collect()
