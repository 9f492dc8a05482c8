"""Queries over sheets, plans, notices, constraints, audits and streams."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import audit, cadence, extract, layout, plan, quality, reconcile, reports, update, versions
from tidemark.registry import query
from tidemark.sources import adapters as A
from tidemark.sources import mailbox as boxes
from tidemark.sources import messages, snapshots
from tidemark.streaming import jobs


def day(text: str):
    return F.lit(text).cast("date")


def mailbox(spark, sf_dir):
    """One message per group of events: a text, an HTML body for every second one, and its events as files."""
    o = A.obs_events(spark, sf_dir)
    said = F.concat("code", F.lit(" "), F.format_string("%.2f", "unit"))
    file = F.struct(F.concat("code", F.lit(".csv")).alias("name"), F.lit(".csv").alias("suffix"), F.lit("text/csv").alias("content_type"), F.encode(said, "UTF-8").alias("payload"))
    per = o.groupBy("message_id", "uid", "sender").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(said)), "\n").alias("t"), F.collect_list(file).alias("attachments"))
    odd = F.col("uid") % 2 == 1
    raw = F.when(F.col("uid") % 5 == 0, F.concat("sender", F.lit(", other@example.com"))).otherwise(F.concat(F.lit("Desk <"), "sender", F.lit(">")))
    return per.select("message_id", "uid", raw.alias("from_raw"), F.lit("NAV").alias("subject"), F.timestamp_seconds(F.col("uid") + 1_700_000_000).alias("sent_at"), F.length("t").cast("long").alias("size"), F.array("t").alias("plain"), F.when(odd, F.array(F.concat(F.lit("<p>"), "t"), F.lit("<p>end"))).alias("html"), "attachments", F.lit("extra").alias("other"))


@query(
    "a1_read_messages",
    "+ m AS (SELECT message_id, uid, sender, string_agg(code||' '||printf('%.2f',unit), chr(10) ORDER BY code||' '||printf('%.2f',unit)) AS t, count(*) AS n, sum(length(code||' '||printf('%.2f',unit))) AS b FROM obs GROUP BY 1,2,3) SELECT kind, message_id, uid, CASE WHEN uid%5<>0 THEN sender END AS sender, 'NAV' AS subject, length(t) AS size, length(t) AS plain_chars, CAST(CASE WHEN uid%2=1 THEN length(t)+9 ELSE 0 END AS BIGINT) AS html_chars, CAST(n AS INTEGER) AS n_files, CAST(b AS BIGINT) AS file_bytes FROM m, (VALUES ('json'),('parquet')) k(kind)",
    "obs",
)
def a1_messages(spark, sf_dir):
    """Written as Parquet and as JSON, and read back by the schema."""
    box, out = mailbox(spark, sf_dir), None
    for kind in ("parquet", "json"):
        path = snapshots.fresh_path(spark, "messages")
        box.write.format(kind).save(path)
        read = messages.header_facts(messages.read_messages(spark, path, kind)).withColumn("kind", F.lit(kind))
        out = read if out is None else out.unionByName(read)
    return out


@query("a3_to_cells", "SELECT 'supplier' AS sheet, CAST(s_suppkey AS INTEGER) AS \"row\", t.c AS col, CASE t.c WHEN 1 THEN s_name ELSE CAST(s_nationkey AS VARCHAR) END AS value FROM supplier, (VALUES (1),(2)) t(c)")
def a3_cells(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    return layout.to_cells(s, F.lit("supplier"), "s_suppkey", ["s_name", "s_nationkey"]).drop("kind")


@query("a4_read_benchmark", "SELECT CAST(bm_date + INTERVAL 20 YEAR AS DATE) AS bm_date, bm_value, false AS duplicate FROM bm", "bm")
def a4_benchmark(spark, sf_dir):
    raw = A.bm_orders(spark, sf_dir).select(F.date_format(A.later("bm_date"), "yyyy/MM/dd").alias("d"), F.col("bm_value").cast("string").alias("v"))
    return snapshots.read_benchmark(raw, "d", "v")


@query("a6_snapshot", "SELECT sheet, nav_date, unit FROM cand", "cand")
def a6_snapshot(spark, sf_dir):
    rows = A.cand(spark, sf_dir).select("sheet", "nav_date", "unit")
    path = snapshots.save_snapshot(rows, "config-1", "scope-1", passed=True)
    return snapshots.load_snapshot(spark, path, "config-1", "scope-1")


@query("a5_write_report", "SELECT sheet, count(*) AS n FROM cand GROUP BY 1", "cand")
def a5_report(spark, sf_dir):
    return snapshots.write_report(A.cand(spark, sf_dir).groupBy("sheet").agg(F.count("*").alias("n")))


@query("a7_publish_version", "SELECT sheet, nav_date, unit, CAST(v AS BIGINT) AS version FROM hist, (VALUES (2),(3)) t(v)", "hist")
def a7_publish(spark, sf_dir):
    rows = A.hist(spark, sf_dir).select("sheet", "nav_date", "unit")
    base = snapshots.fresh_path(spark, "published")
    snapshots.publish_version(rows.where("unit > 0"), base, None, keep=2)
    """Three versions, of which two are kept; the published rows beside each version that is kept."""
    for version in (rows.where("unit > 100"), rows):
        snapshots.publish_version(version, base, snapshots.current_fingerprint(spark, base), keep=2)
    return snapshots.read_published(spark, base).join(F.broadcast(snapshots.versions(spark, base).select("version")), how="cross")  # two rows


#: Headers with their role in a notice and in a sheet whose benchmark is shown as "Demo Index".
HEADERS = (
    ("NAV Date", "date", "date"),
    ("估值基准日", "date", None),
    ("日 期", "date", "date"),
    ("Product Code：", "code", "code"),
    ("份额净值（元）", "unit", "unit"),
    ("最新净值", "unit", None),
    ("NAV", "unit", None),
    ("Unit-NAV", "unit", "unit"),
    ("累计单位净值", "cumulative", "cumulative"),
    ("Cumulative NAV", "cumulative", "cumulative"),
    ("Accumulated_NAV", "cumulative", None),
    ("基金名称", None, "name"),
    ("超额收益", None, "excess"),
    ("Alpha", None, "excess"),
    ("指数成分", None, None),
    ("Index Provider", None, None),
    ("Index Level", None, "benchmark_level"),
    ("沪深指数 收盘", None, "benchmark_level"),
    ("基准 日收益", None, "benchmark_return"),
    ("Benchmark Return", None, "benchmark_return"),
    ("Demo Index", None, "benchmark_level"),
    ("Demo Index (daily return)", None, "benchmark_return"),
    ("收益（周度）", None, "weekly_return"),
    ("Daily Return", None, "daily_return"),
    ("产品收益", None, "return"),
    ("备注", None, None),
    ("", None, None),
)


def listed(rows) -> str:
    """Rows as SQL values behind a running number."""
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()
    return ", ".join(f"({i}, {', '.join(map(cell, row))})" for i, row in enumerate(rows))


@query("c5_c6_headers", f"SELECT o_orderkey AS k, notice_role, sheet_role FROM orders JOIN (VALUES {listed([(a, b) for _, a, b in HEADERS])}) h(i, notice_role, sheet_role) ON i=o_orderkey%{len(HEADERS)}")
def c5_c6(spark, sf_dir):
    head = F.get(F.array(*[F.lit(h[0]) for h in HEADERS]), (F.col("o_orderkey") % len(HEADERS)).cast("int"))
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), head.alias("head"))
    return o.select("k", S.classify_header("head").alias("notice_role"), S.classify_sheet_header("head", F.lit("Demo Index")).alias("sheet_role"))


@query("c12_message_order", "SELECT event_id, CASE WHEN event_id%2=0 THEN 'mailbox-uid' ELSE 'message-date' END AS kind, CASE WHEN event_id%2=0 THEN event_id+1 ELSE epoch_us(ts) END AS ord FROM events")
def c12_order(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_id", S.message_order(F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 1), "ts").alias("o"))
    return e.select("event_id", "o.kind", "o.ord")


@query("c15_typed_cell_hash", "SELECT sheet, \"row\", col, sha256(kind||chr(31)||value) AS hash FROM cells", "cells")
def c15_hash(spark, sf_dir):
    return A.cells_nation(spark, sf_dir).select("sheet", "row", "col", S.typed_cell_hash("kind", "value").alias("hash"))


@query("c14_payload_fingerprint", """SELECT sheet, nav_date, sha256('{"code":"'||code||'","nav_date":"'||nav_date||'","sheet":"'||sheet||'"}') AS fingerprint FROM cand""", "cand")
def c14_fingerprint(spark, sf_dir):
    return A.cand(spark, sf_dir).select("sheet", "nav_date", S.payload_fingerprint("sheet", "nav_date", "code").alias("fingerprint"))


@query("c16_unique_date", "SELECT o_orderkey AS k, CASE WHEN o_orderkey%2=0 AND o_orderdate>=DATE '2000-01-01' THEN CAST(o_orderdate AS DATE) END AS found FROM orders")
def c16_date(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    d = F.col("o_orderdate").cast("date")
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("as of "), F.date_format(d, "yyyy-M-d"), F.lit(", again "), F.date_format(d, "yyyy年M月d日"))).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" or 2030-01-01 and 2030-01-02")))
    return o.select(F.col("o_orderkey").alias("k"), S.unique_date_in_text(said).alias("found"))


def dealt(rows, *keys: str):
    """Rows dealt by keys to as many tasks as the session has shuffle partitions. Without a number small partitions are
    joined, by bytes and, in a union, to few tasks in all; reading notices takes long for their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def notices(spark, sf_dir):
    """One notice per code and month, as a text table whose delimiter goes by the code."""
    s = A.series(spark, sf_dir)
    k = F.substring("code", 2, 9).cast("int") % 4
    d = F.when(k == 0, " | ").when(k == 1, "\t").when(k == 2, ",").otherwise(";")
    line = F.concat("code", d, A.later("nav_date").cast("string"), d, F.format_string("%.6f", "unit"))
    head = F.concat(F.lit("Product Code"), d, F.lit("NAV Date"), d, F.lit("Unit NAV"))
    rows = s.select("code", F.trunc("nav_date", "MM").alias("m"), line.alias("line"), head.alias("head"))
    body = dealt(rows, "code", "m", "head").groupBy("code", "m", "head").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("t"))
    return body.select(F.concat("code", F.lit("-"), F.col("m").cast("string")).alias("message_id"), F.lit("NAV notice").alias("subject"), F.concat("head", F.lit("\n"), "t").alias("plain"), F.lit(None).cast("string").alias("html"))


@query("d1_d2_extract_delimited", "SELECT code, CAST(nav_date + INTERVAL 20 YEAR AS DATE) AS nav_date, unit FROM series WHERE unit<1000000", "series")
def d1_d2(spark, sf_dir):
    return extract.extract_delimited(notices(spark, sf_dir), "message_id", "plain").select("code", "nav_date", "unit")


@query("d3_extract_labelled", "SELECT 'm'||event_id AS message_id, nav_date, unit, code FROM obs WHERE unit>0", "obs")
def d3_labelled(spark, sf_dir):
    o = A.obs_events(spark, sf_dir)
    said = F.concat(F.lit("Product Code: "), "code", F.lit("\nUnit NAV： "), F.format_string("%.2f", "unit"), F.lit("\nRemark: none"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\nNAV Date: "), F.col("nav_date").cast("string"))).otherwise(""))
    m = o.select(F.concat(F.lit("m"), "event_id").alias("message_id"), said.alias("plain"), F.concat(F.lit("NAV "), F.col("nav_date").cast("string")).alias("subject"))
    return extract.extract_labelled(m, "message_id", "plain", "subject").select("message_id", "nav_date", "unit", "code")


def pages(spark, sf_dir):
    rows = A.cand(spark, sf_dir).select("code", F.trunc("nav_date", "MM").alias("m"), F.concat(F.lit("<tr><td>"), "code", F.lit("</td><td>"), A.later("nav_date").cast("string"), F.lit("</td><td>"), F.format_string("%.6f", "unit"), F.lit("</td><td>"), F.format_string("%.6f", "cumulative"), F.lit("</td></tr>")).alias("r"))
    body = dealt(rows, "code", "m").groupBy("code", "m").agg(F.array_join(F.array_sort(F.collect_list("r")), "").alias("t"))
    head = "<p>Dear all,<br>see below</p><table><tr><th rowspan=2>Product Code</th><th rowspan=2>NAV Date</th><th colspan=2>NAV</th></tr><tr><th>Unit NAV</th><th>Cumulative NAV</th></tr>"
    return body.select(F.concat("code", F.lit("-"), F.col("m").cast("string")).alias("message_id"), F.lit("NAV notice").alias("subject"), F.lit(None).cast("string").alias("plain"), F.concat(F.lit(head), "t", F.lit("</table>")).alias("html"))


@query("d4_extract_html_tables", "SELECT code, CAST(nav_date + INTERVAL 20 YEAR AS DATE) AS nav_date, unit, rnd(cumulative,6) AS cumulative FROM cand WHERE cumulative<1000000", "cand")
def d4_html(spark, sf_dir):
    return extract.extract_html_tables(pages(spark, sf_dir), "message_id", "html").select("code", "nav_date", "unit", A.rounded("cumulative", 6).alias("cumulative"))


@query("d5_html_to_text", "SELECT code||'-'||CAST(date_trunc('month',nav_date) AS DATE) AS message_id, '\nDear all,\nsee below\n\nProduct Code\nNAV Date'||string_agg('\n\n'||code||'\n'||CAST(nav_date + INTERVAL 20 YEAR AS DATE)||'\n'||printf('%.6f',unit)||'\n'||printf('%.6f',cumulative), '' ORDER BY nav_date) AS t FROM cand GROUP BY code, date_trunc('month',nav_date)", "cand")
def d5_text(spark, sf_dir):
    said = F.replace(extract.html_to_text("html"), F.lit("\nNAV\n\nUnit NAV\nCumulative NAV"), F.lit(""))
    return pages(spark, sf_dir).select("message_id", said.alias("t"))


def labelled_pages(spark, sf_dir):
    """HTML without tables, whose labelled lines are the only source; every third names its unit value twice."""
    o = dealt(A.event_rows(spark, sf_dir).select("event_id", "code", "nav_date", "unit"), "event_id")
    said = F.concat(F.lit("<div>Product Code: "), "code", F.lit("</div><p>Unit NAV: "), F.format_string("%.2f", "unit"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<p>NAV: "), F.format_string("%.2f", "unit"))).otherwise(""))
    return o.select(F.concat(F.lit("h"), "event_id").alias("message_id"), F.concat(F.lit("notice "), F.col("nav_date").cast("string")).alias("subject"), F.lit(None).cast("string").alias("plain"), said.alias("html"))


@query(
    "d6_extract_observations",
    "SELECT code, CAST(nav_date + INTERVAL 20 YEAR AS DATE) AS nav_date, unit, 'text' AS source FROM series WHERE unit<1000000 UNION ALL SELECT code, CAST(nav_date + INTERVAL 20 YEAR AS DATE), unit, 'html' FROM cand WHERE unit<1000000 UNION ALL SELECT code, nav_date, unit, 'html' FROM obs WHERE unit>0 AND event_id%3<>0 UNION ALL SELECT code, CAST(nav_date + INTERVAL 20 YEAR AS DATE), unit, 'csv' FROM series WHERE unit<1000000 AND number_of(code)%3=0",
    "series",
    "cand",
    "obs",
)
def d6_observations(spark, sf_dir):
    texts = notices(spark, sf_dir).withColumn("message_id", F.concat("message_id", F.lit("t")))
    every = texts.unionByName(pages(spark, sf_dir)).unionByName(labelled_pages(spark, sf_dir)).withColumn("attachments", F.array().cast(FILE_TYPE))
    return extract.extract_observations(every.unionByName(attached(spark, sf_dir))).select("code", "nav_date", "unit", "source")


FILE_TYPE = "array<struct<name: string, suffix: string, content_type: string, payload: binary>>"


def attached(spark, sf_dir):
    """Notices as attachments: by code as they are, with a second one that can't be read, with one that has no records."""
    n = notices(spark, sf_dir)
    k = F.substring("message_id", 2, 4).cast("int") % 3
    file = lambda suffix, payload: F.struct(F.lit("f").alias("name"), F.lit(suffix).alias("suffix"), F.lit("text/plain").alias("content_type"), payload.alias("payload"))
    own = file(".csv", F.encode("plain", "UTF-16"))
    files = F.when(k == 0, F.array(own, file(".png", F.encode(F.lit("x"), "UTF-8")))).when(k == 1, F.array(own, file(".txt", F.unhex(F.lit("FF81FF"))))).otherwise(F.array(file(".CSV", F.encode(F.lit("a,b\n1,2"), "UTF-8"))))
    return n.select(F.concat("message_id", F.lit("a")).alias("message_id"), "subject", F.lit(None).cast("string").alias("plain"), "html", files.alias("attachments"))


@query(
    "d6_extraction_report",
    "+ m AS (SELECT DISTINCT code||'-'||CAST(date_trunc('month',nav_date) AS DATE)||'a' AS message_id, number_of(code)%3 AS k FROM series) SELECT message_id, k=1 AS failed, CASE k WHEN 1 THEN 'txt' ELSE 'csv' END AS suffix, CASE k WHEN 1 THEN 'failed' ELSE 'no-nav-records' END AS status, CASE k WHEN 1 THEN 'invalid-or-unsupported-content' ELSE 'no-structured-nav-records' END AS reason FROM m WHERE k>0",
    "series",
)
def d6_report(spark, sf_dir):
    return extract.extraction_report(attached(spark, sf_dir))


@query("d2_second_header", "SELECT code, CAST(nav_date + INTERVAL 20 YEAR AS DATE) AS nav_date, unit FROM series WHERE unit<1000000 AND number_of(code)%4<>1", "series")
def d2_headers(spark, sf_dir):
    """A first header without rows below it, then the true one; by code a header with two date columns, which rejects."""
    n = notices(spark, sf_dir)
    ambiguous = F.substring("message_id", 2, 4).cast("int") % 4 == 1
    first = F.when(ambiguous, F.lit("NAV Date\tValuation Date\tUnit NAV\n")).otherwise(F.lit("Valuation Date | NAV\nsee | below\nDate;NAV\nsee;below\nDate,NAV\nsee,below\nDate\tNAV\nsee\tbelow\n"))
    return extract.extract_delimited(n.withColumn("plain", F.concat(first, "plain")), "message_id", "plain").select("code", "nav_date", "unit")


@query(
    "d7_fixed_labels",
    "SELECT 'N'||n_nationkey AS \"key\", r IS NULL AS ok, r AS reason, n_name AS name FROM (SELECT *, CASE WHEN n_nationkey%5=4 THEN 'labels' WHEN n_nationkey%5=1 THEN 'identity' WHEN n_nationkey%5=2 THEN 'date' WHEN n_nationkey%5=3 THEN 'value' END AS r FROM nation)",
)
def d7_fixed(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 5
    pair = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    pairs = [
        pair("name", F.col("n_name")),
        pair("issuer", F.when(k == 1, "OTHER").otherwise("ACME")),
        pair("subject date", F.lit("2026-01-09")),
        pair("table date", F.when(k == 2, "2026-01-10").otherwise("20260109")),
        pair("value", F.when(k == 3, "1000000").otherwise("1.5")),
    ]
    rows = F.when(k == 4, F.array(*pairs[1:], pairs[0])).otherwise(F.array(*pairs))
    cells = n.select(F.concat(F.lit("N"), "n_nationkey").alias("key"), F.posexplode(rows).alias("row", "p")).select("key", "row", "p.label", "p.value")
    found = extract.extract_fixed_labels(cells, ["name", "issuer", "subject date", "table date", "value"], {"issuer": "ACME"}, ("subject date", "table date"), ("value",))
    return found.select("key", "ok", "reason", "name")


@query("d8_register_extractor", "SELECT code, count(*) AS n FROM series WHERE unit<1000000 GROUP BY 1", "series")
def d8_extractor(spark, sf_dir):
    """A user's extractor beside the built-in one: both must give rows."""
    extract.register_extractor("last-columns", last_columns)
    return extract.run_extractors(notices(spark, sf_dir), ["auto", "last-columns"]).groupBy("code").agg(F.count("*").alias("n"))


def last_columns(message: dict):
    """Code, date and value of each line of a notice after the first."""
    for line in message["plain"].splitlines()[1:]:
        code, day, unit = map(str.strip, re.split("[|\t,;]", line))
        if float(unit) < 1_000_000:
            yield {"nav_date": dt.date.fromisoformat(day), "unit": float(unit), "code": code}


@query(
    "d8_extractor_failures",
    "+ n AS (SELECT code, code||'-'||CAST(date_trunc('month',nav_date) AS DATE) AS message_id, count(*) FILTER (unit<1000000) AS n FROM series GROUP BY code, date_trunc('month',nav_date)) SELECT message_id, CASE WHEN n=0 THEN 'auto: no-rows' WHEN number_of(code)%3=0 THEN 'odd: invalid-unit' ELSE 'odd: failed: KeyError' END AS reason FROM n WHERE n=0 OR number_of(code)%3<2",
    "series",
)
def d8_failures(spark, sf_dir):
    """Rows of wrong types and errors of a user's extractor, by code."""
    extract.register_extractor("odd", odd_rows)
    return extract.extractor_failures(notices(spark, sf_dir), ["auto", "odd"])


def odd_rows(message: dict):
    kind = int(message["plain"].splitlines()[1][1:5]) % 3
    if kind == 1:
        raise KeyError(kind)
    yield (dt.date(2026, 1, 9), "1.0" if kind == 0 else 1.0, None, None)


@query(
    "a2_read_delimited_payloads",
    "+ n AS (SELECT code||'-'||CAST(date_trunc('month',nav_date) AS DATE) AS message_id, code, CAST(nav_date + INTERVAL 20 YEAR AS DATE) AS d, printf('%.6f',unit) AS u, row_number() OVER (PARTITION BY code, date_trunc('month',nav_date) ORDER BY code||'|'||nav_date) AS r FROM series) SELECT message_id, CAST(r+1 AS INTEGER) AS \"row\", [code, CAST(d AS VARCHAR), u] AS cells FROM n UNION ALL SELECT DISTINCT message_id, 1, ['Product Code','NAV Date','净值, Unit NAV'] FROM n",
    "series",
)
def a2_payloads(spark, sf_dir):
    """UTF-8 with and without a mark, GB18030 bytes and UTF-16, with the delimiter by code; the header holds a comma inside
    quotes."""
    n = notices(spark, sf_dir)
    k = F.substring("message_id", 2, 4).cast("int")
    text = F.replace("plain", F.lit("Unit NAV"), F.lit('"净值, Unit NAV"'))
    gb = F.unhex(F.replace(F.hex(F.encode(text, "UTF-8")), F.hex(F.encode(F.lit("净值"), "UTF-8")), F.lit("BEBBD6B5")))  # the word's bytes in GB18030
    payload = F.when(k % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(k % 3 == 1, gb).otherwise(F.encode(text, "UTF-16"))
    return extract.read_delimited_payloads(n.select("message_id", payload.alias("payload")), "message_id", "payload").select("message_id", "row", "cells")


@query("k1_detect_layout", "SELECT DISTINCT sheet, 1 AS header_row, r.role, r.col FROM cells, (VALUES ('date',1),('code',2),('unit',3),('cumulative',4)) r(role,col)", "cells")
def k1_layout(spark, sf_dir):
    return layout.detect_layout(A.cells_nation(spark, sf_dir))


def nation_sheets(spark, sf_dir):
    c = A.cells_nation(spark, sf_dir)
    found = layout.detect_layout(c)
    h = layout.cells_to_history(c, found)
    return c, found, h, layout.find_total_row(c, h)


@query(
    "k2_pair_benchmark_columns",
    "SELECT 'N'||n_nationkey AS sheet, 1 AS \"row\", CAST(CASE n_nationkey%5 WHEN 2 THEN NULL ELSE 1 END AS INTEGER) AS level_col, 3 AS return_col FROM nation WHERE n_nationkey%5 NOT IN (1,3)",
)
def k2_pairs(spark, sf_dir):
    """By five kinds: named by a word; by the display name (both have roles already); without a level; unnamed; unnamed
    beside an excess column."""
    n = A.table(spark, sf_dir, "nation").withColumn("i", F.col("n_nationkey") % 5)
    name = F.concat("n_name", F.when(F.col("i").isin(0, 2), "指数").otherwise(""))
    level = F.when(F.col("i") == 2, F.concat("n_name", F.lit(" x"))).otherwise(name)
    heads = F.array(level, F.lit("NAV Date"), F.concat(name, F.lit(" (Daily Return)")), F.lit("Other Return"), F.when(F.col("i") == 4, "Excess").otherwise("Remark"))
    sheet = F.concat(F.lit("N"), "n_nationkey")
    cells = n.select(sheet.alias("sheet"), F.lit(1).alias("row"), F.posexplode(heads).alias("col", "value")).withColumn("col", F.col("col") + 1)
    shown = n.where("i = 1").select(sheet.alias("sheet"), F.col("n_name").alias("display_name"))
    return layout.pair_benchmark_columns(cells, shown)


@query("k3_find_total_row", "SELECT 'N'||k AS sheet, CAST(max(r)+1 AS INTEGER) AS total_row, true AS placed FROM nnum GROUP BY k", "cells")
def k3_total(spark, sf_dir):
    return nation_sheets(spark, sf_dir)[3]


@query(
    "k4_check_mode",
    "SELECT 'N'||k AS sheet, CASE k%3 WHEN 0 THEN 'append-with-footer' WHEN 1 THEN CASE WHEN k%7=0 THEN 'template-without-frequency' WHEN k%2=1 THEN 'template-without-return' WHEN k%4=2 THEN 'template-without-benchmark' END END AS issue FROM (SELECT DISTINCT k FROM nnum) WHERE k%3=0 OR (k%3=1 AND (k%7=0 OR k%2=1 OR k%4=2))",
    "cells",
)
def k4_mode(spark, sf_dir):
    _, found, h, totals = widened_sheets(spark, sf_dir)
    number = F.substring("sheet", 2, 9).cast("int")
    k = number % 3
    routes = found.select("sheet").distinct().withColumns({"sheet_mode": F.when(k == 0, "append").when(k == 1, "template").otherwise("summary"), "return_frequency": F.when(number % 7 != 0, "weekly"), "has_benchmark": F.lit(True)})
    return layout.check_mode(found, totals, h, routes)


@query("k5_reserved_row", "SELECT 'N'||k AS sheet, 2 AS row_no, min(d) AS nav_date FROM nnum WHERE k%2=1 AND k%3<>0 AND k%5<>0 GROUP BY k", "cells")
def k5_reserved(spark, sf_dir):
    """Sheets cut to their first dated row: with a value, with another column filled (every second one), or with another
    code, it is no placeholder."""
    c, found, h, _ = widened_sheets(spark, sf_dir)
    number = F.substring("sheet", 2, 9).cast("int")
    first = h.where("row_no = 2").withColumn("unit", F.when(number % 5 == 0, F.col("unit")))
    routes = first.select("sheet", F.when(number % 3 == 0, "ELSE").otherwise(F.col("code")).alias("code"))
    return layout.reserved_row(first, first.select("sheet", F.lit(3).alias("total_row"), F.lit(True).alias("placed")), c.where("row <= 2"), found, routes)


@query("k6_cells_to_history", "SELECT 'N'||k AS sheet, r AS row_no, d AS nav_date, v AS unit, rnd(v+0.5,4) AS cumulative, 'C'||k AS code FROM nnum", "cells")
def k6_history(spark, sf_dir):
    return nation_sheets(spark, sf_dir)[2].withColumn("cumulative", A.rounded("cumulative", 4))


@query("k7_column_roles", "SELECT sheet, CASE col WHEN 1 THEN 'date' WHEN 2 THEN 'code' WHEN 3 THEN 'unit' ELSE 'cumulative' END AS role, chr(CAST(64+col AS INTEGER)) AS letter, value AS header FROM cells WHERE \"row\"=1", "cells")
def k7_roles(spark, sf_dir):
    c, found, _, _ = nation_sheets(spark, sf_dir)
    return layout.column_roles(c, found)


def widened(spark, sf_dir):
    """The sheets with a name column, and by sheet a return column, or benchmark and excess columns with values."""
    c = A.cells_nation(spark, sf_dir)
    k = F.substring("sheet", 2, 9).cast("int")
    per_row = c.where("col = 1").select("sheet", "row", k.alias("k"), "kind", (F.col("row") == 1).alias("head"), (F.col("value") == "TOTAL").alias("total")).where("not total")
    value = lambda head, body: F.when(F.col("head"), head).otherwise(body)
    more = F.array(
        F.struct(F.lit(5).alias("col"), value(F.lit("Product Name"), F.concat(F.lit("Fund "), F.col("k").cast("string"))).alias("value")),
        F.struct(F.lit(6).alias("col"), F.when(F.col("k") % 2 == 0, value(F.lit("Weekly Return"), F.lit("0.1"))).alias("value")),
        F.struct(F.lit(7).alias("col"), F.when(F.col("k") % 4 == 0, value(F.lit("Index Return"), F.lit("0.2"))).alias("value")),
        F.struct(F.lit(8).alias("col"), F.when(F.col("k") % 4 == 0, value(F.lit("Excess"), F.lit("0.3"))).alias("value")),
    )
    extra = per_row.select("sheet", "row", F.inline(more), "kind").where(F.col("value").isNotNull()).select("sheet", "row", "col", "value", "kind")
    return c.unionByName(extra)


def widened_sheets(spark, sf_dir):
    c = widened(spark, sf_dir)
    found = layout.detect_layout(c)
    h = layout.cells_to_history(c, found)
    return c, found, h, layout.find_total_row(c, h)


@query(
    "k8_infer_adoption",
    """+ g AS (SELECT k, date_diff('day', lag(d) OVER (PARTITION BY k ORDER BY d), d) AS gap FROM nnum), m AS (SELECT k, median(gap) AS m, avg(CASE WHEN gap IS NOT NULL THEN CAST(gap>=5 AND least(gap%7,(7-gap%7)%7)<=1 AS INTEGER) END) AS near, count(*) AS n FROM g GROUP BY 1)
SELECT 'N'||nnum.k AS sheet, 'summary' AS mode, 'C'||nnum.k AS code, 'Fund '||nnum.k AS name, CASE WHEN any_value(m.n)<2 THEN 'daily' WHEN any_value(m.m)<=4 THEN 'daily' WHEN any_value(m.m)<=10 THEN 'weekly' WHEN any_value(near)>=0.7 THEN 'weekly' END AS frequency, CAST(max(d)+1 AS DATE) AS series_start, CASE WHEN nnum.k%2=0 THEN 'require' ELSE 'ambiguous' END AS cumulative_policy, nnum.k%4=0 AS benchmark_review FROM nnum JOIN m USING (k) GROUP BY nnum.k""",
    "cells",
)
def k8_adoption(spark, sf_dir):
    c, found, h, totals = widened_sheets(spark, sf_dir)
    cands = h.withColumn("cumulative", F.when(F.substring("sheet", 2, 9).cast("int") % 2 == 0, F.col("cumulative")))
    return layout.infer_adoption(found, h, totals, cadence.infer_frequency(h), cands, c)


@query("g11_table_manifest", "SELECT sheet, max(\"row\") AS max_row, max(col) AS max_col, count(*) AS n_cells, CAST(0 AS BIGINT) AS n_formulas, CAST(count(DISTINCT CASE WHEN \"row\"<=10 OR \"row\">m-30 THEN \"row\" END) AS INTEGER) AS n_sample FROM cells JOIN (SELECT sheet, max(\"row\") AS m FROM cells GROUP BY 1) USING (sheet) GROUP BY 1", "cells")
def g11_manifest(spark, sf_dir):
    return reports.table_manifest(A.cells_nation(spark, sf_dir)).select("sheet", "max_row", "max_col", "n_cells", "n_formulas", F.size("sample").alias("n_sample"))


def changed_cells(spark, sf_dir):
    """Sheets removed, values changed, and a row added, by sheet."""
    c = A.cells_nation(spark, sf_dir)
    k = F.substring("sheet", 2, 9).cast("int")
    changed = c.where(k % 7 != 0).withColumn("value", F.when((k % 5 == 0) & (F.col("row") == 2) & (F.col("col") == 3), "1.0000").otherwise(F.col("value")))
    more = c.where((k % 7 != 0) & (k % 6 == 1) & (F.col("value") == "TOTAL")).withColumn("row", F.col("row") + 1).withColumn("kind", F.lit("formula"))
    return changed.unionByName(more)


CHANGED = "+ s AS (SELECT sheet, CAST(substr(sheet,2) AS INTEGER) AS k, max(\"row\") AS m, max(col) AS c, count(*) AS n FROM cells GROUP BY 1) "


@query(
    "l4_manifest_diff",
    CHANGED + "SELECT sheet, CASE WHEN k%7=0 THEN 'removed' ELSE 'changed' END AS change, CAST(CASE WHEN k%7=0 THEN -m WHEN k%6=1 THEN 1 ELSE 0 END AS INTEGER) AS d_max_row, CASE WHEN k%7=0 THEN -n WHEN k%6=1 THEN 1 ELSE 0 END AS d_n_cells, k%7=0 OR k%5=0 AS values_changed, k%7=0 OR k%6=1 AS formulas_changed, k%7=0 OR k%6=1 AS topology_changed, CASE WHEN k%7=0 THEN 20 WHEN k%6=1 AND m>=40 THEN CASE WHEN k%5=0 THEN 3 ELSE 2 END WHEN k%6=1 THEN CASE WHEN k%5=0 THEN 2 ELSE 1 END ELSE 1 END AS n_rows FROM s WHERE k%7=0 OR k%5=0 OR k%6=1",
    "cells",
)
def l4_diff(spark, sf_dir):
    d = reports.manifest_diff(reports.table_manifest(A.cells_nation(spark, sf_dir)), reports.table_manifest(changed_cells(spark, sf_dir)))
    return d.select("sheet", "change", "d_max_row", "d_n_cells", "values_changed", "formulas_changed", "topology_changed", F.size("rows").alias("n_rows"))


@query("l5_concurrency_report", CHANGED + "SELECT 'changed' AS case, count(*) AS changed_sheets, true AS blocked, false AS metadata_only FROM s WHERE k%7=0 OR k%5=0 OR k%6=1 UNION ALL SELECT 'metadata', 0, true, true UNION ALL SELECT 'same', 0, false, false", "cells")
def l5_concurrency(spark, sf_dir):
    base, other = A.cells_nation(spark, sf_dir), changed_cells(spark, sf_dir)
    named = base.withColumn("author", F.lit("someone"))  # a change outside the cells
    before, fp = reports.table_manifest(base), snapshots.fingerprint_of
    cases = (("changed", reports.concurrency_report(before, reports.table_manifest(other), fp(base), fp(other))), ("metadata", reports.concurrency_report(before, reports.table_manifest(named), fp(base), fp(named))), ("same", reports.concurrency_report(before, before, fp(base), fp(base))))
    out = None
    for name, rows in cases:
        rows = rows.select(F.lit(name).alias("case"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "g9_validation_report",
    """+ c AS (SELECT c.sheet, count(h.nav_date) AS matches, count(*) FILTER (h.nav_date IS NOT NULL AND NOT (abs(c.unit-h.unit)<=1e-6 AND abs(c.cumulative-h.cumulative)<=1e-6)) AS conflicts FROM cand c LEFT JOIN hist h ON h.sheet=c.sheet AND h.nav_date=c.nav_date GROUP BY 1)
SELECT sheet, CASE WHEN matches-conflicts<2 THEN 'short-history' ELSE 'strict' END AS branch, CASE WHEN matches-conflicts<2 THEN 'error' ELSE 'ok' END AS level, NOT (matches-conflicts<2) AND conflicts=0 AS passes FROM c""",
    "hist",
    "cand",
)
def g9_validation(spark, sf_dir):
    c, h = A.cand(spark, sf_dir), A.hist(spark, sf_dir)
    m = reconcile.match_history(c, h).groupBy("sheet").agg(F.count_if(F.col("status") == "matched").alias("matches"), F.count_if(F.col("status") == "conflict").alias("conflicts"))
    no = F.lit(False)
    checks = c.select("sheet").distinct().join(m, "sheet", "left").fillna(0).select("sheet", F.lit("summary").alias("mode"), "matches", "conflicts", F.lit(1).alias("selected"), no.alias("reserved"), no.alias("pending_week"), no.alias("boundary"), F.lit(1).alias("managed"), no.alias("onboarding"), F.lit(0).alias("errors"))
    return reports.validation_report(checks).select("sheet", "branch", "level", "passes")


@query("g10_baseline_report", "SELECT c.sheet, max(t) AS history_latest, count(h.nav_date) AS matched, max(c.nav_date) AS source_latest, count(*) FILTER (h.nav_date IS NULL AND c.nav_date>t) AS pending FROM cand c LEFT JOIN hist h ON h.sheet=c.sheet AND h.nav_date=c.nav_date LEFT JOIN (SELECT sheet, max(nav_date) AS t FROM hist GROUP BY 1) x ON x.sheet=c.sheet GROUP BY 1", "hist", "cand")
def g10_baseline(spark, sf_dir):
    return reports.baseline_report(A.cand(spark, sf_dir), A.hist(spark, sf_dir))


@query(
    "g10_withheld_dates",
    "SELECT c.sheet, list_sort(list(c.nav_date) FILTER (h.nav_date IS NULL AND c.nav_date>t AND date_trunc('week',c.nav_date)=DATE '1999-12-27' AND c.nav_date<=DATE '1999-12-30')) AS w FROM cand c JOIN (SELECT sheet, max(nav_date) AS t FROM hist WHERE nav_date<DATE '1999-12-27' GROUP BY 1) x USING (sheet) LEFT JOIN (SELECT * FROM hist WHERE nav_date<DATE '1999-12-27') h ON h.sheet=c.sheet AND h.nav_date=c.nav_date GROUP BY 1",
    "hist",
    "cand",
)
def g10_withheld(spark, sf_dir):
    h = A.hist(spark, sf_dir).where(F.col("nav_date") < day("1999-12-27"))
    return reports.baseline_report(A.cand(spark, sf_dir), h, day("1999-12-30")).select("sheet", F.when(F.size("withheld") > 0, F.col("withheld")).alias("w"))


@query(
    "g9_validation_facts",
    """+ st AS (SELECT c.sheet, count(h.nav_date) AS m, count(*) FILTER (h.nav_date IS NOT NULL AND NOT (abs(c.unit-h.unit)<=1e-6 AND abs(c.cumulative-h.cumulative)<=1e-6)) AS conflicts, bool_and(h.nav_date IS NOT NULL OR c.nav_date>t) AS safe FROM cand c JOIN (SELECT sheet, max(nav_date) AS t FROM hist GROUP BY 1) x USING (sheet) LEFT JOIN hist h ON h.sheet=c.sheet AND h.nav_date=c.nav_date GROUP BY 1),
mg AS (SELECT sheet, count(*) FILTER (number_of(sheet)%4<>0 OR nav_date>=DATE '1998-01-01') AS managed FROM hist GROUP BY 1), n AS (SELECT sheet, count(*) AS k FROM cand GROUP BY 1)
SELECT sheet, m-conflicts AS matches, conflicts, managed, CASE WHEN number_of(sheet)%10=0 THEN k ELSE 0 END AS errors, false AS boundary, false AS pending_week, number_of(sheet)%9=0 AS reserved FROM st JOIN mg USING (sheet) JOIN n USING (sheet)""",
    "hist",
    "cand",
)
def g9_facts(spark, sf_dir):
    c, h = A.cand(spark, sf_dir), A.hist(spark, sf_dir)
    number = F.substring("sheet", 2, 9).cast("int")
    routes = h.select("sheet").distinct().select("sheet", F.when(number % 10 == 0, "ELSE").otherwise(F.col("sheet")).alias("code"), F.lit("summary").alias("mode"), F.lit("x").alias("product_name"), F.when(number % 4 == 0, day("1998-01-01")).alias("series_start"), F.lit(None).cast("string").alias("baseline_overlap"), F.lit(14).alias("max_staleness_days"))
    facts = reports.validation_facts(c, h, routes, c.limit(0), routes.where(number % 9 == 0), day("2003-01-01"))
    return facts.select("sheet", "matches", "conflicts", "managed", "errors", "boundary", "pending_week", "reserved")


@query("g13_coverage_matrix", "SELECT 'sheet_U'||user_id AS sheet, CASE WHEN user_id%5=0 THEN CASE WHEN user_id%15=0 THEN 'reference' WHEN user_id%10=0 THEN 'excluded' ELSE 'unclassified' END WHEN user_id%17=0 THEN 'paused' WHEN user_id%11=0 THEN 'review-required' ELSE 'active' END AS status FROM (SELECT DISTINCT user_id FROM events)")
def g13_coverage(spark, sf_dir):
    u = A.table(spark, sf_dir, "events").select("user_id").distinct()
    name = F.concat(F.lit("sheet_U"), "user_id").alias("sheet")
    routes = A.routes_events(spark, sf_dir).withColumn("benchmark_review_only", F.substring("code", 2, 9).cast("int") % 11 == 0)
    return reports.coverage_matrix(u.select(name), routes, u.where("user_id % 10 = 0").select(name, F.lit("excluded").alias("status")), u.where("user_id % 15 = 0").select(name)).select("sheet", "status")


@query(
    "g14_operations_summary",
    "SELECT count(*) AS configured, count(*) FILTER (NOT paused) AS active, count(*) FILTER (paused) AS paused, (SELECT count(DISTINCT user_id) FILTER (user_id%10 IN (0,5)) FROM events WHERE user_id%5=0) AS blocking, (SELECT max(ts) FROM events) AS last_finished, (SELECT max_by(event_type<>'error', ts) FROM events) AS last_ok, (SELECT max_by(event_id, ts) FROM events) AS last_rows, (SELECT max(ts) FROM events WHERE event_type<>'error') AS last_good FROM routes",
    "routes",
)
def g14_summary(spark, sf_dir):
    """Reviews of the users without a route; each event stands for a run."""
    e = A.table(spark, sf_dir, "events")
    reviews = e.where("user_id % 5 = 0").select(F.col("user_id").cast("string").alias("sheet"), F.when(F.col("user_id") % 10 == 0, "parser-required").otherwise("business-review").alias("status")).distinct()
    runs = e.select(F.col("ts").alias("finished"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("rows"))
    return reports.operations_summary(A.routes_events(spark, sf_dir), reviews, runs)


PLAN = """+ t AS (SELECT sheet, max(nav_date) AS tail FROM hist GROUP BY 1), n AS (SELECT c.*, tail, row_number() OVER (PARTITION BY c.sheet ORDER BY c.nav_date) AS p FROM cand c ANTI JOIN hist h ON h.sheet=c.sheet AND h.nav_date=c.nav_date LEFT JOIN t ON t.sheet=c.sheet),
pl AS (SELECT sheet, nav_date, unit, cumulative, CASE WHEN nav_date<=tail THEN 'gap' WHEN CAST(substr(sheet,2) AS INTEGER)%9=0 AND p=1 THEN 'fill' ELSE 'append' END AS action, CAST(p AS INTEGER) AS position FROM n)
"""


def built(spark, sf_dir):
    h = A.hist(spark, sf_dir)
    reserved = h.select("sheet").distinct().where(F.substring("sheet", 2, 9).cast("int") % 9 == 0)
    return plan.build_plan(A.cand(spark, sf_dir), h, reserved), h


@query("l1_build_plan", PLAN + "SELECT * FROM pl".replace("*", "sheet, nav_date, unit, action, position"), "hist", "cand")
def l1_plan(spark, sf_dir):
    return built(spark, sf_dir)[0].drop("cumulative")


@query("l1_plan_summary", PLAN + "SELECT sheet, count(*) FILTER (action='append') AS appended, count(*) FILTER (action='fill') AS filled, count(*) FILTER (action='gap') AS gaps, max(nav_date) AS last FROM pl GROUP BY 1", "hist", "cand")
def l1_summary(spark, sf_dir):
    return plan.plan_summary(built(spark, sf_dir)[0])


def applied(spark, sf_dir):
    p, h = built(spark, sf_dir)
    return plan.apply_plan(h, p, F.lit("require"), F.lit(0.0)), p, h


@query("l2_apply_plan", PLAN + "SELECT sheet, nav_date, unit, cumulative, code FROM hist UNION ALL SELECT sheet, nav_date, unit, cumulative, sheet FROM pl WHERE action<>'gap'", "hist", "cand")
def l2_apply(spark, sf_dir):
    return applied(spark, sf_dir)[0]


@query("l3_validate_plan", PLAN + "SELECT sheet, nav_date, 'planned-row-missing' AS issue FROM pl WHERE action<>'gap' AND day(nav_date)=3 UNION ALL SELECT sheet, nav_date, 'unplanned-change' FROM hist WHERE day(nav_date)=4 AND year(nav_date)=1999", "hist", "cand")
def l3_validate(spark, sf_dir):
    after, p, h = applied(spark, sf_dir)
    old = (F.day("nav_date") == 4) & (F.year("nav_date") == 1999)
    damaged = after.where(~((F.day("nav_date") == 3) & (F.year("nav_date") > 1999))).withColumn("unit", F.when(old, F.col("unit") + 1).otherwise(F.col("unit")))
    return plan.validate_plan(h.select("sheet", "nav_date", "unit", "cumulative"), damaged, p)


@query("l6_no_change_baseline", "SELECT c.sheet, max(c.nav_date) AS source_latest FROM cand c GROUP BY 1", "hist", "cand")
def l6_baseline(spark, sf_dir):
    c = A.cand(spark, sf_dir)
    return plan.no_change_baseline(plan.build_plan(c, c), reports.baseline_report(c, c)).select("sheet", "source_latest")


@query("l7_benchmark_review_gate", "SELECT sheet, CASE WHEN CAST(substr(sheet,2) AS INTEGER)%6<>0 THEN unit END AS benchmark_return, CAST(substr(sheet,2) AS INTEGER)%6<>0 AS committable FROM cand", "cand")
def l7_gate(spark, sf_dir):
    c = A.cand(spark, sf_dir)
    r = c.select("sheet").distinct().withColumn("benchmark_review_only", F.substring("sheet", 2, 9).cast("int") % 6 == 0)
    rows = c.select("sheet", F.col("unit").alias("benchmark_return"), F.col("unit").alias("excess_return"))
    return plan.benchmark_review_gate(rows, r).select("sheet", "benchmark_return", "committable")


@query("l8_approval_gate", "SELECT sheet, CAST(substr(code,2) AS INTEGER)%4<>0 AS approved FROM routes", "routes")
def l8_approval(spark, sf_dir):
    r = A.routes_events(spark, sf_dir).select("sheet", "sender", "code", "paused")
    old = r.withColumn("code", F.when(F.substring("code", 2, 9).cast("int") % 4 == 0, F.concat("code", F.lit("x"))).otherwise(F.col("code")))
    old = old.select("sheet", S.payload_fingerprint("sheet", "sender", "code").alias("fingerprint"))
    return plan.approval_gate(r.withColumn("paused", F.lit(True)), old, ["sheet", "sender", "code"])


@query("l9_plan_preflight", PLAN + "SELECT 'config-changed' AS issue, NULL AS sheet UNION ALL SELECT 'plan-expired', NULL UNION ALL SELECT DISTINCT 'sheet-not-active', sheet FROM pl WHERE CAST(substr(sheet,2) AS INTEGER)%8=0", "hist", "cand")
def l9_preflight(spark, sf_dir):
    p, _ = built(spark, sf_dir)
    meta = p.agg(F.count("*").alias("rows")).select("rows", F.lit(True).alias("committable"), F.lit("a").alias("config_fp"), F.lit("b").alias("config_now"), F.lit("c").alias("base_fp"), F.lit("c").alias("base_now"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created"))
    routes = A.hist(spark, sf_dir).select("sheet").distinct().withColumn("paused", F.substring("sheet", 2, 9).cast("int") % 8 == 0)
    return plan.plan_preflight(meta, p, routes, F.lit("2024-01-03 00:00:00").cast("timestamp"))


@query("l10_verify_written", "SELECT sheet, nav_date, CASE day(nav_date) WHEN 9 THEN 'missing' WHEN 10 THEN 'value-differs' ELSE 'weekly-missing' END AS issue FROM hist WHERE day(nav_date) IN (9,10,11)", "hist")
def l10_verify(spark, sf_dir):
    h = A.hist(spark, sf_dir).select("sheet", "nav_date", "unit", "cumulative")
    back = h.where(F.day("nav_date") != 9).withColumn("unit", F.when(F.day("nav_date") == 10, F.col("unit") + 1e-3).otherwise(F.col("unit") + 1e-11))
    back = back.withColumn("weekly", F.when(F.day("nav_date") != 11, F.col("unit")))
    return plan.verify_written(h, back, computed=("weekly",))


UPDATE = """+ r AS (SELECT DISTINCT sheet, number_of(sheet) AS k FROM cand), t AS (SELECT sheet, max(nav_date) AS tail FROM hist GROUP BY 1),
f AS (SELECT c.sheet, c.nav_date, CASE WHEN k%7=0 THEN 0 WHEN k%5=3 THEN 1 WHEN h.nav_date IS NOT NULL AND NOT (abs(c.unit-h.unit)<=1e-6 AND abs(c.cumulative-h.cumulative)<=1e-6) THEN 2 WHEN h.nav_date IS NULL AND c.nav_date<=tail THEN 4 END AS e FROM cand c JOIN r USING (sheet) LEFT JOIN t USING (sheet) LEFT JOIN hist h ON h.sheet=c.sheet AND h.nav_date=c.nav_date),
bad AS (SELECT sheet, min(e) AS e FROM f WHERE e IS NOT NULL GROUP BY 1)
"""


@query(
    "l11_run_update",
    UPDATE + "SELECT f.sheet, ['not-approved','candidate','conflict','period-change','internal-gap'][any_value(bad.e)+1] AS error, count(*) FILTER (bad.e IS NULL AND f.nav_date>tail) AS added, CAST(0 AS BIGINT) AS again, count(*) FILTER (bad.e IS NULL AND f.nav_date>tail)+(SELECT count(*) FROM hist h WHERE h.sheet=f.sheet) AS published FROM f JOIN t USING (sheet) LEFT JOIN bad USING (sheet) GROUP BY 1",
    "hist",
    "cand",
)
def l11_update(spark, sf_dir):
    """A published history is brought up to date, and again: the second run adds nothing. By sheet, some routes aren't
    approved, or have another code."""
    h, c = A.hist(spark, sf_dir), A.cand(spark, sf_dir)
    number = F.substring("sheet", 2, 9).cast("int")
    routes = c.select("sheet").distinct().select("sheet", F.when(number % 5 == 3, "ELSE01").otherwise(F.col("sheet")).alias("code"), (number % 7 != 0).alias("approved"), F.lit("require").alias("cumulative_policy"))
    base = snapshots.fresh_path(spark, "update")
    snapshots.publish_version(h, base, None, keep=3)
    first = update.run_update(spark, base, c, routes, day("2003-01-01"), max_change=1e9)
    again = update.run_update(spark, base, c, routes, day("2003-01-01"), max_change=1e9).select("sheet", F.col("added").alias("again"))
    published = snapshots.read_published(spark, base).groupBy("sheet").agg(F.count("*").alias("published"))
    return first.join(again, "sheet").join(published, "sheet")


@query("i4_keep_and_prune", "SELECT sheet, nav_date FROM (SELECT sheet, nav_date, row_number() OVER (PARTITION BY sheet ORDER BY nav_date DESC) AS n FROM hist) WHERE n<=3 AND nav_date>=DATE '1999-12-20'", "hist")
def i4_keep(spark, sf_dir):
    kept = plan.keep_newest(A.hist(spark, sf_dir), ["sheet"], F.desc("nav_date"), 3)
    return plan.prune_older(kept, "nav_date", day("1999-12-20")).select("sheet", "nav_date")


@query("h5_pending_week", "SELECT DISTINCT sheet, number_of(sheet)%6=0 AS pending FROM hist", "hist")
def h5_pending(spark, sf_dir):
    """A candidate in the week after the last finished one. By sheet: pending; stale; another code; history whose first
    date has no value; a candidate after as_of; none that is new."""
    k = F.substring("sheet", 2, 9).cast("int") % 6
    h = cadence.period_ends(A.hist(spark, sf_dir), "weekly", day("2030-01-01"))
    tail = h.groupBy("sheet").agg(F.max("nav_date").alias("t"))
    monday = F.date_add(S.iso_week("t"), 7)
    new = tail.where(k != 5).select("sheet", F.when(k == 4, F.date_add(monday, 3)).otherwise(monday).alias("nav_date"), F.when(k == 2, "ELSE").otherwise(F.col("sheet")).alias("code"), F.lit(1.0).alias("unit"), F.lit(1.5).alias("cumulative"))
    cand = new.unionByName(h.select(*new.columns))
    first = F.min("nav_date").over(Window.partitionBy("sheet"))
    gaps = h.withColumn("cumulative", F.when(~((k == 3) & (F.col("nav_date") == first)), F.col("cumulative")))
    at = tail.select("sheet", F.date_add(monday, 2).alias("as_of"), F.when(k == 1, 1).otherwise(14).alias("max_staleness_days"))
    return cadence.pending_week_baseline(cand, gaps, at).select("sheet", "pending")


@query("m1_uniqueness", "+ n AS (SELECT sheet, CAST(substr(code,2) AS INTEGER) AS k FROM routes), twice AS (SELECT * FROM (VALUES (1),(2)) t(x)) SELECT sheet, 'code-once-per-sender' AS rule FROM n, twice WHERE k%10=1 UNION ALL SELECT sheet, 'one-route-per-sheet' FROM n WHERE k%10=3 UNION ALL SELECT sheet, 'shared-sender-needs-code' FROM n WHERE k%10=4", "routes")
def m1_unique(spark, sf_dir):
    k = F.substring("code", 2, 9).cast("int") % 10
    r = A.routes_events(spark, sf_dir).select("sheet", "sender", "code", "code_aliases", (k == 4).alias("allow_sender_only"), k.alias("k"))
    other = r.where("k = 1").withColumn("sheet", F.concat("sheet", F.lit("_b")))
    return quality.uniqueness(r.union(other).union(r.where("k = 3")).drop("k"))


@query("m2_route_rules", "SELECT sheet, 'pause-reason' AS rule FROM routes WHERE paused UNION ALL SELECT sheet, 'sender-address' FROM routes WHERE sender LIKE 'desk3%' UNION ALL SELECT sheet, 'staleness-range' FROM routes WHERE CAST(substr(code,2) AS INTEGER)%13=0 UNION ALL SELECT sheet, 'offset-missing' FROM routes WHERE CAST(substr(code,2) AS INTEGER)%7=0 UNION ALL SELECT sheet, rule FROM routes JOIN (VALUES (19,'return-basis'),(23,'data-frequency'),(29,'series-start'),(31,'baseline-overlap'),(37,'binding-code')) v(m, rule) ON CAST(substr(code,2) AS INTEGER)%m=0", "routes")
def m2_rules(spark, sf_dir):
    number = F.substring("code", 2, 9).cast("int")
    r = A.routes_events(spark, sf_dir).withColumns(
        {
            "pause_reason": F.lit(None).cast("string"),
            "sender": F.when(F.col("sender").startswith("desk3"), "desk3 at example").otherwise(F.col("sender")),
            "max_staleness_days": F.when(number % 13 == 0, 400).otherwise(14),
            "sheet_mode": F.lit("summary"),
            "cumulative_policy": F.when(number % 7 == 0, "offset").otherwise("require"),
            "cumulative_offset": F.lit(None).cast("double"),
            "return_frequency": F.lit("weekly"),
            "return_basis": F.when(number % 19 == 0, "gross").otherwise("cumulative"),
            "data_frequency": F.when(number % 23 == 0, "hourly").otherwise("auto"),
            "series_start_text": F.when(number % 29 == 0, "2026-02-30").otherwise("2026-02-28"),
            "baseline_overlap": F.when(number % 31 == 0, "any").otherwise("last_existing_point"),
            "subject_product_code": F.when(number % 37 == 0, "ELSE").otherwise(F.lower("code")),
        }
    )
    return quality.route_rules(r)


def with_benchmark(spark, sf_dir):
    number = F.substring("code", 2, 9).cast("int")
    b = F.struct(
        F.concat(F.lit("src"), (number % 4).cast("string")).alias("source_sheet"),
        F.when(number % 4 == 1, F.when(number % 3 == 0, "aligned_return").otherwise("level")).otherwise("level").alias("source_type"),
        F.lit("Date").alias("source_date"),
        F.when(number % 9 != 0, "Close").alias("source_value"),
        F.when(number % 6 == 1, F.lit(True)).alias("technical_source_verified"),
        F.lit(None).cast("string").alias("license_source"),
        F.lit(None).cast("string").alias("license_approved_by"),
    )
    return A.routes_events(spark, sf_dir).withColumns({"benchmark": b, "benchmark_review_only": number % 8 == 0, "sheet_mode": F.lit("summary")})


@query("m3_benchmark_rules", "+ n AS (SELECT sheet, CAST(substr(code,2) AS INTEGER) AS k FROM routes) SELECT sheet, 'benchmark-fields' AS rule FROM n WHERE k%9=0 UNION ALL SELECT sheet, 'benchmark-provenance' FROM n WHERE k%6=1 UNION ALL SELECT sheet, 'review-with-benchmark' FROM n WHERE k%8=0", "routes")
def m3_rules(spark, sf_dir):
    return quality.benchmark_rules(with_benchmark(spark, sf_dir))


@query("m4_review_rules", "SELECT sheet, 'review-on-managed-sheet' AS rule FROM routes WHERE CAST(substr(code,2) AS INTEGER)%12=1 UNION ALL SELECT sheet, 'review-status' FROM routes WHERE CAST(substr(code,2) AS INTEGER)%12=1 AND CAST(substr(code,2) AS INTEGER)%24=1", "routes")
def m4_rules(spark, sf_dir):
    number = F.substring("code", 2, 9).cast("int")
    r = A.routes_events(spark, sf_dir)
    reviews = r.where(number % 12 == 1).select("sheet", F.when(number % 24 == 1, "whatever").otherwise("excluded").alias("status"), F.lit("ok").alias("reason"))
    return quality.review_rules(reviews, r)


@query(
    "m5_shared_sources",
    "+ n AS (SELECT CAST(substr(code,2) AS INTEGER) AS k FROM routes), d AS (SELECT DISTINCT k%4 AS s, k%4=1 AND k%3=0 AS aligned, k%9=0 AS blank FROM n) SELECT 'src'||s AS source_sheet, count(*) AS definitions FROM d GROUP BY 1 HAVING count(*)>1",
    "routes",
)
def m5_sources(spark, sf_dir):
    return quality.shared_benchmark_sources(with_benchmark(spark, sf_dir))


@query(
    "q1_audit_text",
    r"""WITH l AS (SELECT doc_id, CAST(i AS INTEGER) AS line, string_split(text,chr(10))[i]||CASE (doc_id+i)%7 WHEN 0 THEN ' C:\Users\me\x' WHEN 1 THEN ' see Desktop/a' WHEN 2 THEN ' token = "abcdef"' WHEN 3 THEN ' -----BEGIN RSA PRIVATE KEY-----' WHEN 4 THEN ' a@example.com b@corp.example.org' ELSE '' END AS said FROM documents, range(1, len(string_split(text,chr(10)))+1) t(i))
SELECT doc_id, line, 'absolute-user-path' AS category FROM l WHERE regexp_matches(said,'(?i)[A-Z]:[\\/]Users[\\/][^\\/\s]+') UNION ALL SELECT doc_id, line, 'sync-or-desktop-path' FROM l WHERE regexp_matches(said,'(?i)(OneDrive|Dropbox|Google Drive|Desktop)[\\/]')
UNION ALL SELECT doc_id, line, 'credential-literal' FROM l WHERE regexp_matches(said,'(?i)(password|passwd|api[_-]?key|secret|token)\s*[:=]\s*[''"][^''"]{4,}[''"]') UNION ALL SELECT doc_id, line, 'private-key' FROM l WHERE regexp_matches(said,'-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----')
UNION ALL SELECT doc_id, line, 'non-example-email' FROM l WHERE len(list_filter(regexp_extract_all(said,'(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'), lambda m: NOT regexp_matches(lower(m),'@(example\.com|example\.invalid|users\.noreply\.github\.com)$')))>0""",
)
def q1_audit(spark, sf_dir):
    """Every line of the documents, with something that is looked for behind most of them."""
    more = ("C:\\Users\\me\\x", "see Desktop/a", 'token = "abcdef"', "-----BEGIN RSA PRIVATE KEY-----", "a@example.com b@corp.example.org")
    tail = F.coalesce(F.get(F.array(*[F.lit(f" {m}") for m in more]), F.pmod(F.col("doc_id") + F.col("i"), F.lit(7)).cast("int")), F.lit(""))
    lines = A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "said")).withColumn("i", F.col("i") + 1)
    text = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat("said", tail).alias("said")))), lambda x: x["said"]), "\n").alias("text"))
    return audit.audit_text(text, "doc_id", "text")


@query(
    "m6_option_bounds",
    "WITH o AS (SELECT s_suppkey AS k, ['minimum_history_dates','tolerance','max_future_days','max_period_change','zero_threshold','backup_count','log_days','other'][s_suppkey%8+1] AS option, CASE WHEN s_suppkey%3=0 THEN 0.0 WHEN s_suppkey%3=1 THEN 0.005 ELSE 5000.0 END AS value FROM supplier) SELECT DISTINCT option, CAST(value AS DOUBLE) AS value, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM o LEFT JOIN (VALUES ('minimum_history_dates',2,100),('tolerance',0,0.01),('max_future_days',0,7),('max_period_change',0.001,10),('zero_threshold',0,0.1),('backup_count',1,100),('log_days',1,3650)) b(option, low, high) USING (option) WHERE low IS NULL OR NOT value BETWEEN low AND high OR (option='tolerance' AND value<=0)",
)
def m6_bounds(spark, sf_dir):
    names = ("minimum_history_dates", "tolerance", "max_future_days", "max_period_change", "zero_threshold", "backup_count", "log_days", "other")
    k = F.col("s_suppkey")
    o = A.table(spark, sf_dir, "supplier").select(F.get(F.array(*map(F.lit, names)), (k % 8).cast("int")).alias("option"), F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.005).otherwise(5000.0).alias("value"))
    return quality.option_bounds(o).distinct()


#: Names of files with their category.
FILES = (("config.json", "runtime-artifact"), ("Config.json", "unexpected-file-type"), ("report.PDF", "binary-or-data-artifact"), ("notes.md", None), (".gitignore", None), ("LICENSE", None), ("data.parquet", "unexpected-file-type"), ("run.lock", "runtime-artifact"), ("poetry.lock", None))


@query(
    "q2_audit_paths",
    f"WITH f AS (SELECT page_id, i FROM pages JOIN range({len(FILES)}) t(i) ON i=page_id%{len(FILES)}) SELECT page_id, category FROM f JOIN (VALUES {listed([(c,) for _, c in FILES])}) v(i, category) USING (i) WHERE category IS NOT NULL UNION ALL SELECT page_id, 'sync-or-desktop-path' FROM f WHERE page_id%4=0",
)
def q2_audit(spark, sf_dir):
    name = F.get(F.array(*[F.lit(n) for n, _ in FILES]), (F.col("page_id") % len(FILES)).cast("int"))
    path = F.concat(F.when(F.col("page_id") % 4 == 0, "Desktop/").otherwise("docs/"), name)
    return audit.audit_paths(A.table(spark, sf_dir, "pages").select("page_id", path.alias("path")), "page_id", "path")


#: UTF-8 bytes of the same word as they look in Latin-1, Windows-1252 and GBK, and the word itself.
GARBLED = ("å\x9fºé\x87\x91", "åŸºé‡‘", "鍩洪噾", "基金")


@query("q3_garbled_text", "SELECT o_orderkey AS k, CASE WHEN o_orderkey%4<3 THEN '基金'||o_orderpriority END AS again FROM orders")
def q3_garbled(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    seen = F.concat(F.get(F.array(*map(F.lit, GARBLED)), (F.col("o_orderkey") % 4).cast("int")), "o_orderpriority")
    return o.select(F.col("o_orderkey").alias("k"), audit.garbled_text(seen).alias("again"))


@query("n2_completed_weeks", "+ k AS (SELECT code, date_trunc('week',ts) AS w, max_by(value, struct_pack(t:=ts, e:=obs.event_id)) AS unit FROM obs JOIN events USING (event_id) GROUP BY 1,2) SELECT code, CAST(w AS DATE) AS week, unit FROM k WHERE w < TIMESTAMP '2024-01-29'".replace("obs JOIN events USING (event_id)", "obs JOIN (SELECT event_id, ts, value FROM events) x ON x.event_id=obs.event_id"), "obs")
def n2_weeks(spark, sf_dir):
    return jobs.completed_weeks(spark, sf_dir)


@query("n3_stream_dedup", "SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(DISTINCT 1) AS n FROM events GROUP BY 1,2,3")
def n3_dedup(spark, sf_dir):
    return jobs.deduplicated(spark, sf_dir).groupBy("user_id", "event_type", "day").agg(F.count("*").alias("n"))


@query("n1_stream_observations", "SELECT event_id, user_id, event_type, value FROM events")
def n1_stream(spark, sf_dir):
    return jobs.ingested(spark, sf_dir).select("event_id", "user_id", "event_type", "value")


@query(
    "n4_stream_corrections",
    "+ d AS (SELECT code, nav_date, coalesce(max(CASE WHEN event_type='error' THEN event_id END), min(event_id)) AS base, count(*) AS n FROM obs GROUP BY 1,2) SELECT d.code, CAST(d.nav_date AS VARCHAR) AS day, max(CASE WHEN o.event_id=base THEN unit END) AS unit, bool_or(o.event_id>base AND o.unit<>b.u) AS conflict, any_value(n) AS n FROM d JOIN obs o ON o.code=d.code AND o.nav_date=d.nav_date JOIN (SELECT event_id, unit AS u FROM obs) b ON b.event_id=base GROUP BY 1,2",
    "obs",
)
def n4_stream(spark, sf_dir):
    return jobs.corrected(spark, sf_dir)


@query("n5_stream_append", "SELECT event_id, 'U'||user_id AS code, value AS unit, CAST(ts AS DATE) AS nav_date FROM events")
def n5_append(spark, sf_dir):
    return jobs.appended(spark, sf_dir)


def stored_mailboxes(spark, sf_dir):
    """The mailbox of events as a store with a mailbox per desk."""
    path = snapshots.fresh_path(spark, "mailboxes")
    box = mailbox(spark, sf_dir).withColumn("mailbox", F.concat(F.lit("box"), F.col("uid") % 4))
    box.withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz")).repartition("mailbox").sortWithinPartitions("uid").write.partitionBy("mailbox").parquet(f"{path}/by-field")
    return f"{path}/by-field"


@query(
    "a1_mailbox_source",
    "+ m AS (SELECT message_id, uid, sender FROM obs GROUP BY 1,2,3) SELECT 'mailbox=box'||(uid%4) AS mailbox, message_id, uid, sender FROM m WHERE uid%5<>0 AND uid>2000 AND sender IN ('desk1@example.com','desk2@example.com','desk7@example.com')",
    "obs",
)
def a1_mailbox(spark, sf_dir):
    """Conditions on header fields go to the source."""
    boxes.register(spark)
    read = spark.read.format("mailbox").load(stored_mailboxes(spark, sf_dir))
    return read.where((F.col("uid") > 2000) & F.col("sender").isin("desk1@example.com", "desk2@example.com", "desk7@example.com")).select("mailbox", "message_id", "uid", "sender")


@query("n1_mailbox_stream", "+ m AS (SELECT message_id, uid FROM obs GROUP BY 1,2) SELECT 'mailbox=box'||(uid%4) AS mailbox, uid, message_id FROM m", "obs")
def n1_mailbox(spark, sf_dir):
    """Batches bounded by bytes, one a run, each going on where the one before ended, until nothing is left."""
    boxes.register(spark)
    path, base = stored_mailboxes(spark, sf_dir), snapshots.fresh_path(spark, "mailbox-stream")
    size = spark.read.parquet(path).groupBy("mailbox").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 1
    while True:
        stream = spark.readStream.format("mailbox").options(progress=f"{base}/progress", max_bytes=str(size // 3), max_messages="1000000000").load(path)
        job = stream.select("mailbox", "uid", "message_id").writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        job = job.format("parquet").option("path", f"{base}/rows").start()
        job.awaitTermination()
        if not job.lastProgress or not job.lastProgress["numInputRows"]:
            return spark.read.schema("mailbox string, uid long, message_id string").parquet(f"{base}/rows")


@query(
    "l4_changed_ranges",
    """WITH old AS (SELECT 'L'||(o_custkey%10) AS sheet, CAST(o_orderkey AS INTEGER) AS r FROM orders), d AS (SELECT DISTINCT sheet, r FROM old WHERE r%97<3 OR (sheet='L3' AND r%8=7)),
g AS (SELECT *, r-row_number() OVER (PARTITION BY sheet ORDER BY r) AS k FROM d) SELECT sheet, min(r) AS first_row, max(r) AS last_row, count(*) AS cells FROM g GROUP BY sheet, k""",
)
def l4_ranges(spark, sf_dir):
    """Orders as cells of ten sheets; in the second version some rows' values are others, and rows of one sheet are gone."""
    rows = A.table(spark, sf_dir, "orders").select(F.concat(F.lit("L"), F.col("o_custkey") % 10).alias("sheet"), F.col("o_orderkey").cast("int").alias("row"), F.lit(1).alias("col"), F.lit("value").alias("kind"), F.col("o_totalprice").cast("string").alias("value"))
    new = rows.where((F.col("sheet") != "L3") | (F.col("row") % 8 != 7)).withColumn("value", F.when(F.col("row") % 97 < 3, F.concat("value", F.lit("0"))).otherwise(F.col("value")))
    old, new = snapshots.stored(rows, "cells"), snapshots.stored(new, "cells")
    trees = [snapshots.stored(versions.digest_tree(x), "digests") for x in (old, new)]  # kept with a version
    return versions.changed_ranges(old, new, versions.differing_blocks(*trees))
