"""The engine's inputs made from the driver tables (see FIXTURES.md), as DataFrames and as SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2000-02-16"


def rounded(c, digits: int):
    """Half up by double arithmetic alone, as in the oracle, so that ties fall alike in both engines."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def later(c):
    """A date 20 years on, as text knows dates of this century only. Leap years stay leap years."""
    return F.add_months(c, 240)


def exact_sum(name: str):
    """Sum of a column with two decimals, the same in any order of rows."""
    return F.sum(F.col(name).cast("decimal(18,2)")).cast("double")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, nav_date, unit: mean price per unit of a supplier's items by ship date."""
    items = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 4, "0")).alias("code"), F.col("l_shipdate").cast("date").alias("nav_date"), "l_extendedprice", "l_quantity"
    )
    return items.groupBy("code", "nav_date").agg(rounded(exact_sum("l_extendedprice") / exact_sum("l_quantity"), 6).alias("unit"))


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).where(F.col("nav_date") < F.lit("2000-01-01").cast("date"))
    return s.select(F.col("code").alias("sheet"), "code", "nav_date", "unit", (F.col("unit") + F.when(F.day("nav_date") == 15, 0.75).otherwise(0.5)).alias("cumulative"))


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).where(F.col("nav_date") >= F.lit("1999-12-01").cast("date"))
    unit = F.when(F.day("nav_date") == 7, rounded(F.col("unit") * 1.01, 6)).otherwise(F.col("unit"))
    return s.select(F.col("code").alias("sheet"), "code", "nav_date", unit.alias("unit"), (F.col("unit") + 0.5).alias("cumulative"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event, without what its message's other events say."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.concat(F.lit("U"), F.col("user_id")).alias("code"),
        F.col("ts").cast("date").alias("nav_date"),
        F.col("value").alias("unit"),
        F.when(~F.col("event_type").isin("view", "click"), F.col("value") + 1).alias("cumulative"),
        F.concat(F.lit("desk"), F.col("user_id") % 10, F.lit("@example.com")).alias("sender"),
        F.concat(F.lit("U"), F.col("user_id"), F.lit("-"), F.col("ts").cast("date").cast("string"), F.lit("-"), F.floor(F.hour("ts") / 6).cast("string")).alias("message_id"),
    )


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event; a user's events of six hours are one message."""
    e = event_rows(spark, sf_dir)
    per = e.groupBy("message_id").agg(F.max("event_id").alias("uid"), F.max((F.col("event_type") == "error").cast("int")).alias("c"))
    return e.join(per.withColumnRenamed("message_id", "m"), F.col("message_id") == F.col("m")).select(
        "event_id", "user_id", "code", "nav_date", "unit", "cumulative", "sender", "message_id", "uid", (F.col("c") == 1).alias("correction"), "event_type"
    )


def routes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 5 <> 0")
    return u.select(
        F.concat(F.lit("sheet_U"), F.col("user_id")).alias("sheet"),
        F.concat(F.lit("desk"), F.col("user_id") % 10, F.lit("@example.com")).alias("sender"),
        F.concat(F.lit("U"), F.col("user_id")).alias("code"),
        F.array(F.concat(F.lit("U"), F.col("user_id"), F.lit("A"))).alias("code_aliases"),
        (F.col("user_id") % 17 == 0).alias("paused"),
        F.when(F.col("user_id") % 17 == 0, "on hold").alias("pause_reason"),
        F.when(F.col("user_id") % 3 == 0, F.lit("2024-01-10").cast("date")).alias("series_start"),
        F.lit(False).alias("allow_sender_only"),
        F.lit(14).alias("max_staleness_days"),
    )


def bm_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("bm_date")).agg(rounded(exact_sum("o_totalprice") / F.count("*"), 4).alias("bm_value"))


def cells_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per nation: a header row, the mean order value per month as dated rows, and a total row."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.groupBy(F.col("c_nationkey").alias("k"), later(F.trunc(F.col("o_orderdate").cast("date"), "MM")).alias("d")).agg(rounded(exact_sum("o_totalprice") / F.count("*") / 1000, 4).alias("v"))
    from pyspark.sql import Window

    rows = rows.withColumn("row", (F.row_number().over(Window.partitionBy("k").orderBy("d")) + 1).cast("int"))
    sheet = F.concat(F.lit("N"), F.col("k"))
    head = F.array(F.array(F.lit("NAV Date"), F.lit("净值日期"), F.lit("Valuation Date")), F.array(F.lit("Product Code"), F.lit("产品代码"), F.lit("Fund Code")), F.array(F.lit("Unit NAV"), F.lit("单位净值"), F.lit("份额净值")), F.array(F.lit("Cumulative NAV"), F.lit("累计净值"), F.lit("累计单位净值")))
    keys = rows.select("k").distinct()
    header = keys.select(sheet.alias("sheet"), F.lit(1).alias("row"), F.posexplode(F.transform(head, lambda h: F.get(h, (F.col("k") % 3).cast("int")))).alias("col", "value"), F.lit("text").alias("kind"))
    values = F.array(F.col("d").cast("string"), F.concat(F.lit("C"), F.col("k")), F.format_string("%.4f", "v"), F.format_string("%.4f", F.col("v") + 0.5))
    body = rows.select(sheet.alias("sheet"), "row", F.posexplode(values).alias("col", "value"), F.lit("value").alias("kind"))
    last = rows.groupBy("k").agg((F.max("row") + 1).cast("int").alias("row"))
    total = last.select(sheet.alias("sheet"), "row", F.lit(0).alias("col"), F.lit("TOTAL").alias("value"), F.lit("text").alias("kind"))
    return header.union(body).union(total).withColumn("col", (F.col("col") + 1).cast("int"))


SQL: dict[str, str] = {
    "series": """series AS (SELECT 'S'||lpad(CAST(l_suppkey AS VARCHAR),4,'0') AS code, CAST(l_shipdate AS DATE) AS nav_date,
 rnd(xsum(l_extendedprice)/xsum(l_quantity),6) AS unit FROM lineitem GROUP BY 1,2)""",
    "hist": """hist AS (SELECT code AS sheet, code, nav_date, unit, unit + CASE WHEN day(nav_date)=15 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS cumulative
 FROM series WHERE nav_date < DATE '2000-01-01')""",
    "cand": """cand AS (SELECT code AS sheet, code, nav_date, CASE WHEN day(nav_date)=7 THEN rnd(unit*1.01::DOUBLE,6) ELSE unit END AS unit, unit+0.5::DOUBLE AS cumulative
 FROM series WHERE nav_date >= DATE '1999-12-01')""",
    "obs": """ev AS (SELECT event_id, user_id, event_type, 'U'||user_id AS code, CAST(ts AS DATE) AS nav_date, value AS unit,
 CASE WHEN event_type NOT IN ('view','click') THEN value+1 END AS cumulative, 'desk'||(user_id%10)||'@example.com' AS sender,
 'U'||user_id||'-'||CAST(CAST(ts AS DATE) AS VARCHAR)||'-'||(hour(ts)//6) AS message_id FROM events),
 obs AS (SELECT *, max(event_id) OVER (PARTITION BY message_id) AS uid, bool_or(event_type='error') OVER (PARTITION BY message_id) AS correction FROM ev)""",
    "routes": """routes AS (SELECT 'sheet_U'||user_id AS sheet, 'desk'||(user_id%10)||'@example.com' AS sender, 'U'||user_id AS code, 'U'||user_id||'A' AS alias,
 user_id%17=0 AS paused, CASE WHEN user_id%3=0 THEN DATE '2024-01-10' END AS series_start FROM (SELECT DISTINCT user_id FROM events WHERE user_id%5<>0))""",
    "bm": """bm AS (SELECT CAST(o_orderdate AS DATE) AS bm_date, rnd(xsum(o_totalprice)/count(*),4) AS bm_value FROM orders GROUP BY 1)""",
    "cells": """nrows AS (SELECT c_nationkey AS k, CAST(date_trunc('month', o_orderdate) + INTERVAL 20 YEAR AS DATE) AS d, rnd(xsum(o_totalprice)/count(*)/1000,4) AS v FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2),
 nnum AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY d)+1 AS INTEGER) AS r FROM nrows),
 cells AS (SELECT 'N'||k AS sheet, 1 AS "row", c AS col, CASE c WHEN 1 THEN ['NAV Date','净值日期','Valuation Date'][k%3+1] WHEN 2 THEN ['Product Code','产品代码','Fund Code'][k%3+1] WHEN 3 THEN ['Unit NAV','单位净值','份额净值'][k%3+1] ELSE ['Cumulative NAV','累计净值','累计单位净值'][k%3+1] END AS value, 'text' AS kind
 FROM (SELECT DISTINCT k FROM nrows), (VALUES (1),(2),(3),(4)) t(c)
 UNION ALL SELECT 'N'||k, r, c, CASE c WHEN 1 THEN CAST(d AS VARCHAR) WHEN 2 THEN 'C'||k WHEN 3 THEN printf('%.4f', v) ELSE printf('%.4f', v+0.5) END, 'value' FROM nnum, (VALUES (1),(2),(3),(4)) t(c)
 UNION ALL SELECT 'N'||k, CAST(max(r)+1 AS INTEGER), 1, 'TOTAL', 'text' FROM nnum GROUP BY k)""",
}
NEEDS = {"hist": ("series",), "cand": ("series",)}


def expanded(body: str) -> str:
    """rnd(x, n): half up by double arithmetic; xsum(x): exact sum of a column with two decimals; number_of(code): its number."""
    body = re.sub(r"number_of\(([\w.]+)\)", r"CAST(substr(\1,2,4) AS INTEGER)", body)
    body = re.sub(r"xsum\((\w+)\)", r"CAST(sum(CAST(\1 AS DECIMAL(18,2))) AS DOUBLE)", body)
    while (at := body.find("rnd(")) >= 0:
        depth, end, comma = 1, at + 4, 0
        while depth:
            c = body[end]
            depth += (c == "(") - (c == ")")
            comma = end if c == "," and depth == 1 else comma
            end += 1
        scale = f"{10 ** int(body[comma + 1 : end - 1])}.0::DOUBLE"
        body = f"{body[:at]}(floor(({body[at + 4 : comma]})*{scale}+0.5::DOUBLE)/{scale}){body[end:]}"
    return body


def sql(body: str, *uses: str) -> str:
    """body with the adapters that it uses in front; a body that begins with + goes on with tables of its own."""
    order: list[str] = []
    for u in uses:
        for x in (*NEEDS.get(u, ()), u):
            if x not in order:
                order.append(x)
    own = body.lstrip()
    if not order:
        return expanded(own)
    return expanded("WITH " + ",\n".join(SQL[x] for x in order) + ("\n," + own[1:] if own[0] == "+" else "\n" + own))
