"""Queries over the supplier price series: functions, cadence, returns and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import cadence, reconcile, returns
from tidemark.registry import query
from tidemark.sources import adapters as A
from tidemark.sources import snapshots



def day(text: str):
    return F.lit(text).cast("date")


def keyed(spark, sf_dir):
    return A.series(spark, sf_dir).select(F.col("code").alias("sheet"), "nav_date", "unit")


@query(
    "h7_h8_returns",
    """+ w AS (SELECT code AS sheet, nav_date, unit, CAST(date_trunc('week', nav_date) AS DATE) AS wk, lead(CAST(date_trunc('week', nav_date) AS DATE)) OVER (PARTITION BY code ORDER BY nav_date) AS nwk FROM series),
e AS (SELECT *, wk < DATE '2001-10-15' AND (nwk IS NULL OR nwk > wk) AS fin FROM w),
p AS (SELECT *, unit/lag(unit) OVER (PARTITION BY sheet ORDER BY nav_date)-1 AS d, last_value(CASE WHEN fin THEN unit END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY nav_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e)
SELECT sheet, nav_date, unit, rnd(d,8) AS daily_return, rnd(CASE WHEN fin THEN unit/prev-1 END,8) AS weekly_return FROM p""",
    "series",
)
def h7_h8_returns(spark, sf_dir):
    rows = returns.weekly_return(returns.daily_return(keyed(spark, sf_dir)), day("2001-10-17"))
    return rows.select("sheet", "nav_date", "unit", A.rounded("daily_return", 8).alias("daily_return"), A.rounded("weekly_return", 8).alias("weekly_return"))


@query(
    "h6_period_ends",
    "SELECT code AS sheet, max(nav_date) AS nav_date, max_by(unit, nav_date) AS unit FROM series WHERE date_trunc('week', nav_date) < DATE '2001-10-15' GROUP BY code, date_trunc('week', nav_date)",
    "series",
)
def h6_period_ends(spark, sf_dir):
    return cadence.period_ends(keyed(spark, sf_dir), "weekly", day("2001-10-17")).select("sheet", "nav_date", "unit")


@query(
    "h9_total_return",
    """+ e AS (SELECT code, max(nav_date) AS d, max_by(unit, nav_date) AS u FROM series WHERE date_trunc('week', nav_date) < DATE '2001-10-15' GROUP BY code, date_trunc('week', nav_date))
SELECT code AS sheet, rnd(max_by(u,d)/min_by(u,d)-1,8) AS total_return, count(*) AS periods FROM e GROUP BY 1""",
    "series",
)
def h9_total_return(spark, sf_dir):
    t = returns.total_return(keyed(spark, sf_dir), "weekly", day("2001-10-17"))
    return t.select("sheet", A.rounded("total_return", 8).alias("total_return"), "periods")


@query(
    "h1_infer_frequency",
    """+ g AS (SELECT code, nav_date - lag(nav_date) OVER (PARTITION BY code ORDER BY nav_date) AS gap FROM series),
a AS (SELECT code, count(*) AS dates, median(gap) AS m, avg(CASE WHEN gap IS NULL THEN NULL WHEN gap>=5 AND least(gap%7,(7-gap%7)%7)<=1 THEN 1 ELSE 0 END) AS near FROM g GROUP BY 1)
SELECT code AS sheet, dates, m AS median_gap, CASE WHEN dates<2 THEN 'daily' WHEN m<=4 THEN 'daily' WHEN m<=10 THEN 'weekly' WHEN near>=0.7 THEN 'weekly' END AS frequency, CASE WHEN dates<2 THEN 'email-source' ELSE 'history' END AS source FROM a""",
    "series",
)
def h1_infer_frequency(spark, sf_dir):
    return cadence.infer_frequency(keyed(spark, sf_dir))


@query(
    "h1_frequency_kept_up",
    """+ g AS (SELECT code, nav_date - lag(nav_date) OVER (PARTITION BY code ORDER BY nav_date) AS gap FROM series),
a AS (SELECT code, count(*) AS dates, median(gap) AS m, avg(CASE WHEN gap IS NULL THEN NULL WHEN gap>=5 AND least(gap%7,(7-gap%7)%7)<=1 THEN 1 ELSE 0 END) AS near FROM g GROUP BY 1)
SELECT code AS sheet, dates, m AS median_gap, CASE WHEN dates<2 THEN 'daily' WHEN m<=4 THEN 'daily' WHEN m<=10 THEN 'weekly' WHEN near>=0.7 THEN 'weekly' END AS frequency, CASE WHEN dates<2 THEN 'email-source' ELSE 'history' END AS source FROM a""",
    "series",
)
def h1_kept_up(spark, sf_dir):
    """Histograms of three stretches of time, each made from its own dates only; repeated dates change nothing."""
    rows = keyed(spark, sf_dir).select("sheet", "nav_date")
    state = None
    for least, most in (("0001-01-01", "1996-03-31"), ("1996-03-15", "1999-06-30"), ("1999-06-30", "9999-01-01")):
        new = rows.where(F.col("nav_date").between(F.lit(least).cast("date"), F.lit(most).cast("date")))
        more = cadence.gap_histogram(new, state)
        state = snapshots.stored(more if state is None else cadence.merged_histograms(state, more), "gap-histogram")
    return cadence.frequency_of(state)


@query(
    "h1_infer_frequency_sparse",
    """WITH g AS (SELECT DISTINCT 'K'||o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), l AS (SELECT k, d, d-lag(d) OVER (PARTITION BY k ORDER BY d) AS gap FROM g),
a AS (SELECT k, count(*) AS dates, median(gap) AS m, avg(CASE WHEN gap IS NULL THEN NULL WHEN gap>=5 AND least(gap%7,(7-gap%7)%7)<=1 THEN 1 ELSE 0 END) AS near FROM l GROUP BY 1)
SELECT k AS sheet, dates, m AS median_gap, CASE WHEN dates<2 THEN 'daily' WHEN m<=4 THEN 'daily' WHEN m<=10 THEN 'weekly' WHEN near>=0.7 THEN 'weekly' END AS frequency, CASE WHEN dates<2 THEN 'email-source' ELSE 'history' END AS source FROM a""",
)
def h1_sparse(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.concat(F.lit("K"), "o_custkey").alias("sheet"), F.col("o_orderdate").cast("date").alias("nav_date"))
    return cadence.infer_frequency(o)


@query(
    "h2_preferred_weekday",
    """+ c AS (SELECT sheet, CAST(isodow(nav_date)-1 AS INTEGER) AS wd, count(*) AS n, max(nav_date) AS last FROM hist GROUP BY 1,2)
SELECT sheet, max_by(wd, struct_pack(n:=n, l:=last)) AS weekday FROM c GROUP BY 1""",
    "hist",
)
def h2_preferred_weekday(spark, sf_dir):
    return cadence.preferred_weekday(A.hist(spark, sf_dir))


WEEKLY = """+ wh AS (SELECT sheet, max(nav_date) AS nav_date, max_by(unit,nav_date) AS unit FROM hist GROUP BY sheet, date_trunc('week',nav_date)),
c AS (SELECT sheet, CAST(isodow(nav_date)-1 AS INTEGER) AS wd, count(*) AS n, max(nav_date) AS last FROM wh GROUP BY 1,2),
pw AS (SELECT sheet, max_by(wd, struct_pack(n:=n, l:=last)) AS weekday FROM c GROUP BY 1),
x AS (SELECT cand.sheet, cand.nav_date, cand.unit, date_trunc('week',cand.nav_date) AS wk, wh.nav_date IS NOT NULL AS known, isodow(cand.nav_date)-1 <= weekday AS early FROM cand LEFT JOIN wh USING (sheet,nav_date) LEFT JOIN pw ON pw.sheet=cand.sheet),
y AS (SELECT *, bool_or(known) OVER w AS anyk, coalesce(max(CASE WHEN early THEN nav_date END) OVER w, min(nav_date) OVER w) AS pick FROM x WINDOW w AS (PARTITION BY sheet, wk)),
sel AS (SELECT sheet, nav_date, unit FROM y WHERE CASE WHEN anyk THEN known WHEN wk >= DATE '2000-02-14' THEN false ELSE nav_date=pick END)
"""


def weekly_hist(spark, sf_dir):
    return cadence.period_ends(A.hist(spark, sf_dir), "weekly", day("2001-01-01"))


@query("h3_select_weekly", WEEKLY + "SELECT sheet, nav_date, unit FROM sel", "hist", "cand")
def h3_select_weekly(spark, sf_dir):
    return cadence.select_weekly(A.cand(spark, sf_dir), weekly_hist(spark, sf_dir), day("2000-02-16")).select("sheet", "nav_date", "unit")


@query(
    "h4_withheld_current_week",
    WEEKLY + "SELECT DISTINCT c.sheet, c.nav_date FROM cand c JOIN (SELECT sheet, max(nav_date) AS t FROM wh GROUP BY 1) USING (sheet) ANTI JOIN sel s ON s.sheet=c.sheet AND s.nav_date=c.nav_date WHERE c.nav_date>t AND date_trunc('week',c.nav_date)=DATE '2000-02-14' AND c.nav_date<=DATE '2000-02-16'",
    "hist",
    "cand",
)
def h4_withheld(spark, sf_dir):
    return cadence.withheld_current_week(A.cand(spark, sf_dir), weekly_hist(spark, sf_dir), day("2000-02-16"))


ENDS = """+ e AS (SELECT code AS sheet, max(nav_date) AS nav_date, max_by(unit, nav_date) AS unit FROM series WHERE date_trunc('week', nav_date) < DATE '2001-10-15' GROUP BY code, date_trunc('week', nav_date)),
j AS (SELECT e.*, bm_value FROM e LEFT JOIN bm ON bm_date=nav_date)
"""


@query("f8_join_benchmark", ENDS + "SELECT sheet, nav_date, bm_value, bm_value IS NULL AS missing FROM j", "series", "bm")
def f8_join_benchmark(spark, sf_dir):
    return returns.join_benchmark(h6_period_ends(spark, sf_dir), A.bm_orders(spark, sf_dir)).select("sheet", "nav_date", "bm_value", "missing")


@query(
    "h10_h12_level_and_excess",
    ENDS
    + "SELECT sheet, nav_date, rnd(bm_value/lag(bm_value) OVER w-1,8) AS benchmark_return, rnd(unit/lag(unit) OVER w-1-(bm_value/lag(bm_value) OVER w-1),8) AS excess_return FROM j WINDOW w AS (PARTITION BY sheet ORDER BY nav_date)",
    "series",
    "bm",
)
def h10_h12_excess(spark, sf_dir):
    rows = returns.level_return(h6_period_ends(spark, sf_dir), A.bm_orders(spark, sf_dir))
    rows = returns.excess_return(rows.withColumn("own", F.col("unit") / F.lag("unit").over(cadence.by_date()) - 1), "own")
    return rows.select("sheet", "nav_date", A.rounded("benchmark_return", 8).alias("benchmark_return"), A.rounded("excess_return", 8).alias("excess_return"))


@query("h11_aligned_return", "+ r AS (SELECT bm_date, bm_value/lag(bm_value) OVER (ORDER BY bm_date)-1 AS v FROM bm) SELECT code AS sheet, nav_date, rnd(v,8) AS benchmark_return FROM series LEFT JOIN r ON bm_date=nav_date", "series", "bm")
def h11_aligned(spark, sf_dir):
    from pyspark.sql import Window

    b = A.bm_orders(spark, sf_dir)  # one row per date
    b = b.select("bm_date", (F.col("bm_value") / F.lag("bm_value").over(Window.orderBy("bm_date")) - 1).alias("bm_value"))
    return returns.aligned_return(keyed(spark, sf_dir), b).select("sheet", "nav_date", A.rounded("benchmark_return", 8).alias("benchmark_return"))


@query(
    "h13_compound_return",
    "+ e AS (SELECT code AS sheet, nav_date, unit FROM series), r AS (SELECT sheet, unit/lag(unit) OVER (PARTITION BY sheet ORDER BY nav_date) AS g FROM e) SELECT sheet, rnd(exp(sum(ln(coalesce(g,1))))-1,6) AS compound_return FROM r GROUP BY 1",
    "series",
)
def h13_compound(spark, sf_dir):
    return returns.compound_return(returns.daily_return(keyed(spark, sf_dir)), "daily_return").select("sheet", A.rounded("compound_return", 6).alias("compound_return"))


@query(
    "h14_series_reset",
    "SELECT code AS sheet, count(*) AS n, min(nav_date) AS first FROM series WHERE CAST(substr(code,2) AS INTEGER)%3<>0 OR CAST(substr(code,2) AS INTEGER)%2=0 OR nav_date>=DATE '1999-06-01' GROUP BY 1",
    "series",
)
def h14_series_reset(spark, sf_dir):
    number = F.substring("code", 2, 9).cast("int")
    r = A.series(spark, sf_dir).select("code").distinct().select(F.col("code").alias("sheet"), F.when(number % 3 == 0, day("1999-06-01")).alias("series_start"), F.when(number % 2 == 0, "last_existing_point").alias("baseline_overlap"))
    return returns.series_reset(keyed(spark, sf_dir), r).groupBy("sheet").agg(F.count("*").alias("n"), F.min("nav_date").alias("first"))


@query("f4_match_history", "SELECT c.sheet, c.nav_date, CASE WHEN abs(c.unit-h.unit)<=1e-6 AND NOT (number_of(c.sheet)%5=2) AND coalesce(abs(CASE WHEN day(c.nav_date)%2=0 THEN CASE number_of(c.sheet)%3 WHEN 0 THEN c.unit WHEN 1 THEN c.unit+0.5 END ELSE c.cumulative END-h.cumulative),0)<=1e-6 THEN 'matched' ELSE 'conflict' END AS status FROM cand c JOIN hist h ON c.sheet=h.sheet AND c.nav_date=h.nav_date", "hist", "cand")
def f4_match_history(spark, sf_dir):
    """Half of the candidates lack the cumulative value, which is taken by policy; a fifth bear another name."""
    number = F.substring("code", 2, 9).cast("int")
    c = A.cand(spark, sf_dir).withColumns({"cumulative": F.when(F.day("nav_date") % 2 == 1, F.col("cumulative")), "name": F.when(number % 5 == 2, "Other").when(number % 5 == 3, "DEMO (fund)")})
    return reconcile.match_history(c, A.hist(spark, sf_dir).withColumn("name", F.lit("Demo Fund")), routes=odd_routes(spark, sf_dir))


@query("f5_new_rows", "SELECT c.sheet, c.nav_date, c.unit FROM cand c ANTI JOIN hist h ON c.sheet=h.sheet AND c.nav_date=h.nav_date", "hist", "cand")
def f5_new_rows(spark, sf_dir):
    return reconcile.new_rows(A.cand(spark, sf_dir), A.hist(spark, sf_dir)).select("sheet", "nav_date", "unit")


HOLES = "+ h2 AS (SELECT * FROM hist WHERE day(nav_date)<>20) "


@query("f6_internal_gaps", HOLES + "SELECT c.sheet, c.nav_date, t AS tail FROM cand c JOIN (SELECT sheet, max(nav_date) AS t FROM h2 GROUP BY 1) USING (sheet) ANTI JOIN h2 h ON c.sheet=h.sheet AND c.nav_date=h.nav_date WHERE c.nav_date<=t", "hist", "cand")
def f6_internal_gaps(spark, sf_dir):
    return reconcile.internal_gaps(A.cand(spark, sf_dir), A.hist(spark, sf_dir).where(F.day("nav_date") != 20))


@query(
    "f7_period_change_check",
    """+ n AS (SELECT c.sheet, c.nav_date, c.unit FROM cand c ANTI JOIN hist h ON c.sheet=h.sheet AND c.nav_date=h.nav_date), u AS (SELECT sheet,nav_date,unit,false AS new FROM hist WHERE number_of(sheet)%4<>0 OR nav_date>=DATE '1999-12-20' UNION ALL SELECT *, true FROM n),
v AS (SELECT *, lag(unit) OVER (PARTITION BY sheet ORDER BY nav_date) AS previous FROM u) SELECT sheet, nav_date, unit, previous FROM v WHERE new AND abs(unit/previous-1)>0.5""",
    "hist",
    "cand",
)
def f7_period_change(spark, sf_dir):
    routes = odd_routes(spark, sf_dir).withColumn("series_start", F.when(F.col("series_start").isNotNull(), day("1999-12-20")))
    return reconcile.period_change_check(A.cand(spark, sf_dir), A.hist(spark, sf_dir), routes=routes)


def boundary_routes(spark, sf_dir):
    tail = A.hist(spark, sf_dir).groupBy("sheet").agg(F.max("nav_date").alias("t"))
    return tail.select("sheet", F.date_add("t", 1).alias("series_start"), F.lit("last_existing_point").alias("baseline_overlap"), F.when(F.substring("sheet", 2, 9).cast("int") % 6 == 0, "ELSE01").otherwise(F.col("sheet")).alias("code"))


@query(
    "f9_boundary_anchor",
    """+ t AS (SELECT sheet, max(nav_date) AS t, max_by(unit,nav_date) AS tu, max_by(cumulative,nav_date) AS tc FROM hist GROUP BY 1)
SELECT t.sheet, coalesce(number_of(t.sheet)%6<>0 AND count(DISTINCT (c.unit, c.cumulative))=1 AND bool_and(coalesce(abs(c.unit-tu)<=1e-6 AND abs(c.cumulative-tc)<=1e-6,false)),false) AS verified FROM t LEFT JOIN cand c ON c.sheet=t.sheet AND c.nav_date=t.t GROUP BY 1""",
    "hist",
    "cand",
)
def f9_boundary_anchor(spark, sf_dir):
    return reconcile.verify_boundary_anchor(A.cand(spark, sf_dir), A.hist(spark, sf_dir), boundary_routes(spark, sf_dir))


@query(
    "f13_identity_evidence",
    """+ h AS (SELECT sheet, count(DISTINCT code) AS n, min(code) AS code, max(nav_date) AS t FROM hist GROUP BY 1),
c AS (SELECT c.sheet, bool_and(x.nav_date IS NOT NULL OR c.nav_date>h.t) AS safe FROM cand c LEFT JOIN (SELECT sheet,nav_date FROM hist) x ON x.sheet=c.sheet AND x.nav_date=c.nav_date JOIN h ON h.sheet=c.sheet GROUP BY 1)
SELECT h.sheet, CASE WHEN NOT safe THEN NULL WHEN number_of(sheet)%10<>0 AND number_of(sheet)%3<2 THEN 'both' WHEN number_of(sheet)%10<>0 THEN 'code' WHEN number_of(sheet)%3<2 THEN 'name' END AS evidence FROM h JOIN c USING (sheet)""",
    "hist",
    "cand",
)
def f13_identity(spark, sf_dir):
    """By code a route with another code; a product name that is the sheet's, the one in history, or neither."""
    number = F.substring("sheet", 2, 9).cast("int")
    routes = odd_routes(spark, sf_dir).withColumn("product_name", F.when(number % 3 == 0, F.lower("sheet")).when(number % 3 == 1, "Demo (Fund)").otherwise("Other"))
    return reconcile.identity_evidence(A.hist(spark, sf_dir).withColumn("name", F.lit("demo fund")), A.cand(spark, sf_dir), routes)


@query(
    "f14_reserved_partial",
    """+ r AS (SELECT sheet, min(nav_date) AS d FROM cand GROUP BY 1), rr AS (SELECT r.sheet, d, CASE WHEN CAST(substr(r.sheet,2) AS INTEGER)%2=0 THEN unit+1 ELSE unit END AS u FROM r JOIN cand ON cand.sheet=r.sheet AND nav_date=d)
SELECT rr.sheet, bool_or(coalesce(abs(c.unit-u)<=1e-6,false)) AS verified FROM rr LEFT JOIN cand c ON c.sheet=rr.sheet AND c.nav_date=d GROUP BY 1""",
    "cand",
)
def f14_reserved(spark, sf_dir):
    c = A.cand(spark, sf_dir)
    first = c.groupBy("sheet").agg(F.min("nav_date").alias("nav_date"), F.min_by("unit", "nav_date").alias("u"))
    odd = F.substring("sheet", 2, 9).cast("int") % 2 == 0
    return reconcile.verify_reserved_partial(c, first.select("sheet", "nav_date", F.when(odd, F.col("u") + 1).otherwise(F.col("u")).alias("unit"), F.lit(None).cast("double").alias("cumulative")))


@query(
    "h15_spread_break",
    "+ s AS (SELECT sheet,nav_date,cumulative-unit AS x, lag(cumulative-unit) OVER w AS b, lead(cumulative-unit) OVER w AS a FROM hist WINDOW w AS (PARTITION BY sheet ORDER BY nav_date)) SELECT sheet,nav_date FROM s WHERE abs(b-a)<=1e-5 AND abs(x-b)>1e-5",
    "hist",
)
def h15_spread_break(spark, sf_dir):
    return reconcile.spread_break(A.hist(spark, sf_dir))


@query("h16_policy_break", "SELECT sheet,nav_date FROM hist WHERE abs(cumulative-unit-0.5)>1e-5", "hist")
def h16_policy_break(spark, sf_dir):
    return reconcile.policy_break(A.hist(spark, sf_dir), F.lit(0.5))


@query("h17_missing_values", "SELECT code AS sheet, nav_date, CASE WHEN unit>345 THEN 'missing-unit' ELSE 'missing-cumulative' END AS issue FROM obs WHERE unit>345 OR cumulative IS NULL", "obs")
def h17_missing(spark, sf_dir):
    o = A.obs_events(spark, sf_dir).select(F.col("code").alias("sheet"), "nav_date", F.when(F.col("unit") <= 345, F.col("unit")).alias("unit"), "cumulative")
    return reconcile.missing_values(o)


def odd_routes(spark, sf_dir):
    number = F.substring("code", 2, 9).cast("int")
    return A.series(spark, sf_dir).select("code").distinct().select(
        F.col("code").alias("sheet"),
        F.when(number % 10 == 0, F.concat("code", F.lit("X"))).otherwise(F.col("code")).alias("code"),
        F.when(number % 4 == 0, day("1998-01-01")).alias("series_start"),
        F.when(number % 3 == 0, "unit").when(number % 3 == 1, "offset").otherwise("require").alias("cumulative_policy"),
        F.lit(0.5).alias("cumulative_offset"),
    )


@query("h18_code_constancy", "SELECT sheet, nav_date, code, code||'X' AS expected FROM hist WHERE CAST(substr(code,2) AS INTEGER)%10=0", "hist")
def h18_code_constancy(spark, sf_dir):
    return reconcile.code_constancy(A.hist(spark, sf_dir), odd_routes(spark, sf_dir))


@query(
    "h19_history_integrity",
    """+ s AS (SELECT sheet,nav_date,cumulative-unit AS x, lag(cumulative-unit) OVER w AS b, lead(cumulative-unit) OVER w AS a FROM hist WINDOW w AS (PARTITION BY sheet ORDER BY nav_date)),
i AS (SELECT sheet,nav_date,'spread-break' AS issue FROM s WHERE abs(b-a)<=1e-5 AND abs(x-b)>1e-5 AND number_of(sheet)%3=2 UNION ALL SELECT sheet,nav_date,'policy-break' FROM s WHERE abs(x-CASE number_of(sheet)%3 WHEN 0 THEN 0 ELSE 0.5 END)>1e-5 AND number_of(sheet)%3<2 UNION ALL SELECT sheet,nav_date,'unexpected-code' FROM hist WHERE CAST(substr(code,2) AS INTEGER)%10=0)
SELECT sheet, issue, CAST(substr(sheet,2) AS INTEGER)%4<>0 OR nav_date>=DATE '1998-01-01' AS managed, count(*) AS n, CAST(substr(sheet,2) AS INTEGER)%4<>0 OR nav_date>=DATE '1998-01-01' AS repair_required FROM i GROUP BY 1,2,3""",
    "hist",
)
def h19_integrity(spark, sf_dir):
    return reconcile.history_integrity(A.hist(spark, sf_dir), odd_routes(spark, sf_dir))


@query("h20_candidate_checks", "SELECT sheet, nav_date, CASE WHEN nav_date>DATE '2001-10-01' THEN 'future-date' ELSE 'code-mismatch' END AS issue FROM cand WHERE nav_date>DATE '2001-10-01' OR CAST(substr(code,2) AS INTEGER)%10=0", "cand")
def h20_candidate_checks(spark, sf_dir):
    return reconcile.candidate_checks(A.cand(spark, sf_dir), odd_routes(spark, sf_dir), day("2001-10-01"))


@query(
    "h21_order_check",
    "WITH o AS (SELECT 'K'||l_suppkey AS sheet, l_orderkey*10+l_linenumber AS row_no, CAST(l_shipdate AS DATE) AS d, lag(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey*10+l_linenumber, l_shipdate) AS b FROM lineitem) SELECT sheet, count(*) FILTER (d<b) AS back, count(*) FILTER (d=b) AS same FROM o GROUP BY 1",
)
def h21_order_check(spark, sf_dir):
    from pyspark.sql import Window

    items = A.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("K"), "l_suppkey").alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.col("l_shipdate").cast("date").alias("nav_date"))
    items = items.withColumn("row_no", F.row_number().over(Window.partitionBy("sheet").orderBy("n", "nav_date")))
    found = reconcile.order_check(items)
    return items.select("sheet").distinct().join(found, "sheet", "left").groupBy("sheet").agg(F.count_if(F.col("issue") == "not-ascending").alias("back"), F.count_if(F.col("issue") == "duplicate-date").alias("same"))


@query(
    "x1_risk",
    "+ r AS (SELECT code AS sheet, unit/lag(unit) OVER (PARTITION BY code ORDER BY nav_date)-1 AS r FROM series), a AS (SELECT sheet, avg(r)*252 AS m, stddev_samp(r)*sqrt(252) AS v FROM r WHERE r IS NOT NULL GROUP BY 1) SELECT sheet, rnd(m,6) AS annualised_return, rnd(v,6) AS volatility, rnd((m-0.02)/v,6) AS sharpe FROM a",
    "series",
)
def x1_risk(spark, sf_dir):
    r = returns.risk(returns.daily_return(keyed(spark, sf_dir)), "daily_return", 252, 0.02)
    return r.select("sheet", *[A.rounded(c, 6).alias(c) for c in ("annualised_return", "volatility", "sharpe")])


@query(
    "x2_max_drawdown",
    "+ p AS (SELECT code AS sheet, nav_date, unit/max(unit) OVER (PARTITION BY code ORDER BY nav_date)-1 AS f FROM series) SELECT sheet, rnd(min(f),8) AS max_drawdown, min_by(nav_date, struct_pack(f:=f, d:=nav_date)) AS trough_date FROM p GROUP BY 1",
    "series",
)
def x2_max_drawdown(spark, sf_dir):
    return returns.max_drawdown(keyed(spark, sf_dir)).select("sheet", A.rounded("max_drawdown", 8).alias("max_drawdown"), "trough_date")


@query(
    "x2_long_max_drawdown",
    "+ p AS (SELECT code AS sheet, nav_date, unit/max(unit) OVER (PARTITION BY code ORDER BY nav_date)-1 AS f FROM series) SELECT sheet, rnd(min(f),8) AS max_drawdown, min_by(nav_date, struct_pack(f:=f, d:=nav_date)) AS trough_date FROM p GROUP BY 1",
    "series",
)
def x2_long_drawdown(spark, sf_dir):
    return returns.long_max_drawdown(keyed(spark, sf_dir)).select("sheet", A.rounded("max_drawdown", 8).alias("max_drawdown"), "trough_date")


@query("h7_long_daily_return", "SELECT code AS sheet, nav_date, rnd(unit/lag(unit) OVER (PARTITION BY code ORDER BY nav_date)-1,8) AS daily_return FROM series", "series")
def h7_long_return(spark, sf_dir):
    return returns.long_daily_return(keyed(spark, sf_dir), days=100).select("sheet", "nav_date", A.rounded("daily_return", 8).alias("daily_return"))


@query(
    "x2_calmar",
    """+ p AS (SELECT code AS sheet, unit/max(unit) OVER (PARTITION BY code ORDER BY nav_date)-1 AS f, unit/lag(unit) OVER (PARTITION BY code ORDER BY nav_date)-1 AS r FROM series)
SELECT sheet, rnd(CASE WHEN min(f)<0 THEN avg(r)*252 / -min(f) END,6) AS calmar FROM p GROUP BY 1 HAVING count(r)>=2""",
    "series",
)
def x2_calmar(spark, sf_dir):
    s = keyed(spark, sf_dir)
    return returns.calmar(s, returns.daily_return(s), "daily_return", 252).select("sheet", A.rounded("calmar", 6).alias("calmar"))


@query(
    "x3_merge_benchmarks",
    """+ p AS (SELECT * FROM bm WHERE day(bm_date)%3<>0), b AS (SELECT bm_date, CASE WHEN day(bm_date)%5=0 THEN bm_value+1 ELSE bm_value END AS v FROM bm)
SELECT bm_date, coalesce(p.bm_value, b.v) AS bm_value, CASE WHEN p.bm_value IS NOT NULL THEN 'primary' ELSE 'backup' END AS provenance, coalesce(abs(p.bm_value-b.v)>1e-9,false) AS differs FROM p FULL JOIN b USING (bm_date)""",
    "bm",
)
def x3_merge_benchmarks(spark, sf_dir):
    b = A.bm_orders(spark, sf_dir)
    return returns.merge_benchmark_sources(b.where(F.day("bm_date") % 3 != 0), b.select("bm_date", F.when(F.day("bm_date") % 5 == 0, F.col("bm_value") + 1).otherwise(F.col("bm_value")).alias("bm_value")))


@query(
    "c1_c4_c8_text_functions",
    """SELECT n_nationkey AS k, nullif(upper(regexp_replace(n_name||'-a b_0'||n_nationkey,'[^A-Za-z0-9]','','g')),'') AS code, lower(regexp_replace(' '||n_name||' (x): [y]','[\\s_:/：()（）\\[\\]-]','','g')) AS header,
substr(sha256(n_name||chr(31)||n_nationkey||chr(31)),1,12) AS short FROM nation""",
)
def c1_text(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    dirty = F.concat("n_name", F.lit("-a b_0"), "n_nationkey")
    return n.select(F.col("n_nationkey").alias("k"), S.normalize_code(dirty).alias("code"), S.normalize_header(F.concat(F.lit(" "), "n_name", F.lit(" (x): [y]"))).alias("header"), S.short_id("n_name", "n_nationkey", F.lit(None).cast("string")).alias("short"))


@query(
    "c2_c3_parse",
    """SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber=1 THEN NULL ELSE nullif(CASE WHEN l_extendedprice*20 < 1000000 THEN rnd(l_extendedprice*20,2) END, 0) END AS number,
CASE WHEN l_linenumber=2 OR (l_linenumber=1 AND l_partkey%3=1) THEN NULL ELSE CAST(l_shipdate + INTERVAL 20 YEAR AS DATE) END AS day FROM lineitem""",
)
def c2_c3_parse(spark, sf_dir):
    i = A.table(spark, sf_dir, "lineitem")
    d, line, kind = A.later(F.col("l_shipdate").cast("date")), F.col("l_linenumber"), F.col("l_partkey") % 3
    number = F.format_number(A.rounded(F.col("l_extendedprice") * 20, 2), 2)
    raw = F.when(line == 1, F.concat(number, F.lit("%"))).otherwise(number)
    spelt = lambda *forms: F.get(F.array(*[F.date_format(d, f) for f in forms]), kind.cast("int"))
    date = (
        F.when(line == 1, F.when(kind == 1, F.date_format(F.add_months(d, -360), "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy.M.d")))  # 1982 to 1998: another century
        .when(line == 2, F.concat(F.year(d).cast("string"), F.lit("-13-"), F.day(d).cast("string")))
        .when(line == 3, spelt("yyyy年M月d日", "yy年MM月dd日", "至 yyyy年M月d日 止"))
        .when(line == 4, F.date_format(d, "yyyyMMdd"))
        .when((line == 5) & (F.year(d) == 2020), F.date_format(d, "yy.MM.dd"))  # 20yyMM would be a year and a month
        .when(line == 5, spelt("yyMMdd", "yy-MM-dd", "yy/MM/dd"))
        .when(line == 6, F.date_diff(d, day("1899-12-30")).cast("string"))
        .otherwise(F.date_format(d, "yyyy/MM/dd"))
    )
    return i.select(F.col("l_orderkey").alias("k"), line.alias("n"), S.parse_number(raw).alias("number"), S.parse_date(date).alias("day"))


@query("c13_columns", "SELECT DISTINCT CAST(l_partkey%2000+1 AS INTEGER) AS n, CAST(l_partkey%2000+1 AS INTEGER) AS again, length(CASE WHEN l_partkey%2000+1<=26 THEN 'A' WHEN l_partkey%2000+1<=702 THEN 'AA' ELSE 'AAA' END) AS letters FROM lineitem")
def c13_columns(spark, sf_dir):
    n = A.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 2000 + 1).cast("int").alias("n")).distinct()
    return n.select("n", S.column_index(S.column_letter("n")).alias("again"), F.length(S.column_letter("n")).cast("long").alias("letters"))


@query("c9_c10_c11", "SELECT event_id, coalesce(cumulative, unit) AS by_unit, coalesce(cumulative, unit+0.25) AS by_offset, round_even(unit,1) AS rounded, CAST(date_trunc('week',nav_date) AS DATE) AS week, date_trunc('week',nav_date) < DATE '2024-01-15' AS completed FROM obs", "obs")
def c9_c11(spark, sf_dir):
    o = A.obs_events(spark, sf_dir)
    return o.select(
        "event_id",
        S.effective_cumulative("unit", "cumulative", F.lit("unit"), F.lit(0.0)).alias("by_unit"),
        S.effective_cumulative("unit", "cumulative", F.lit("offset"), F.lit(0.25)).alias("by_offset"),
        S.row_signature("unit", "cumulative", 1)["unit"].alias("rounded"),
        S.iso_week("nav_date").alias("week"),
        S.is_completed_week("nav_date", day("2024-01-17")).alias("completed"),
    )


@query("b12_sign_bucket", "+ r AS (SELECT code, nav_date, unit/lag(unit) OVER (PARTITION BY code ORDER BY nav_date)-1 AS r FROM series) SELECT CASE WHEN r IS NULL THEN NULL WHEN r>=5e-5 THEN 'positive' WHEN r<=-5e-5 THEN 'negative' ELSE 'zero' END AS bucket, count(*) AS n FROM r GROUP BY 1", "series")
def b12_sign_bucket(spark, sf_dir):
    return returns.daily_return(keyed(spark, sf_dir)).groupBy(S.sign_bucket("daily_return").alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "h1_frequency_settings",
    """+ g AS (SELECT code, date_diff('day', lag(nav_date) OVER (PARTITION BY code ORDER BY nav_date), nav_date) AS gap FROM series WHERE number_of(code)%5<>0 OR nav_date=(SELECT min(nav_date) FROM series s2 WHERE s2.code=series.code)),
m AS (SELECT code, count(*) AS n, median(gap) AS m, avg(CASE WHEN gap IS NOT NULL THEN CAST(gap>=5 AND least(gap%7,(7-gap%7)%7)<=1 AS INTEGER) END) AS near FROM g GROUP BY 1),
k AS (SELECT code, n, CASE WHEN n<2 THEN CASE WHEN number_of(code)%2=0 THEN 'weekly' ELSE 'daily' END WHEN m<=4 THEN 'daily' WHEN m<=10 THEN 'weekly' WHEN near>=0.7 THEN 'weekly' END AS f FROM m)
SELECT code AS sheet, f AS frequency, CASE WHEN n>=2 THEN 'history' WHEN number_of(code)%2=0 THEN 'header' ELSE 'email-source' END AS source, CASE WHEN f IS NULL THEN 'unprovable' WHEN number_of(code)%3=1 AND f<>'weekly' THEN 'disagrees' END AS issue FROM k""",
    "series",
)
def h1_settings(spark, sf_dir):
    """A fifth of the series cut to their first date; a return header names weekly for half of them; a third configured."""
    s = A.series(spark, sf_dir)
    number = F.substring("code", 2, 9).cast("int")
    first = s.groupBy("code").agg(F.min("nav_date").alias("_first"))
    cut = s.join(first, "code").where((number % 5 != 0) | (F.col("nav_date") == F.col("_first"))).select(F.col("code").alias("sheet"), "nav_date")
    settings = first.select(F.col("code").alias("sheet"), F.when(number % 3 == 1, "weekly").otherwise("auto").alias("configured"), F.when(number % 2 == 0, "weekly").alias("hint"))
    return cadence.infer_frequency(cut, settings).select("sheet", "frequency", "source", "issue")
