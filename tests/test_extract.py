"""Notices taken apart: single values by the same rules as columns, files, limits, and users' extractors."""

import datetime as dt
import random

import pytest

from tidemark.functions import scalars as S
from tidemark.operators import extract


def test_values_are_read_as_columns_are(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("0123456789.-/,，年月日 20+%e") for _ in range(r.randint(0, 12))) for _ in range(3000)]
    texts += [f"{r.choice(['20', '19', ''])}{r.randint(0, 99):02d}{s}{r.randint(0, 13)}{s}{r.randint(0, 32)}" for s in ("", "-", "/", ".") for _ in range(200)]
    texts += ["46031", "46031.5", "20000", "99999", "2026年1月9日", "", " 1.5 ", "1,234.5", "NAV Date", "净值日期", "Cumulative NAV (x)", "Fund-Code", "unit_nav", "[NAV]", "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.parse_date("t").alias("d"), S.parse_number("t").alias("n"), S.classify_header("t").alias("r"), S.normalize_code("t").alias("c")).collect()
    for row in got:
        assert (extract.day(row.t), extract.number(row.t), extract.role(row.t), extract.code(row.t)) == (row.d, row.n, row.r, row.c), row.t


def table(**more):
    return {"subject": "notice", "plain": "Product Code | NAV Date | Unit NAV\nA1 | 2026-01-09 | 1.01"} | more


def attached(payload: bytes, suffix: str = ".csv"):
    return {"subject": "notice", "attachments": [{"suffix": suffix, "payload": payload}]}


def test_quoted_cells_and_encodings():
    text = 'Remark,NAV Date,Unit NAV\n"a ""quoted"", long\nremark",2026-01-09,1.01\n'
    assert extract.delimited_table(text)[1] == ['a "quoted", long\nremark', "2026-01-09", "1.01"]
    for codec in ("utf-8", "utf-8-sig", "gb18030", "utf-16"):
        read = extract.read_message(attached(text.replace("Remark", "净值日").encode(codec)))
        assert [(r.unit, r.source) for r in read.rows] == [(1.01, "csv")], codec
    assert extract.read_message(attached(b"\xff\x81\xff")).files == [("csv", "failed", "invalid-or-unsupported-content")]
    assert extract.read_message(attached(b"x", ".png")) == extract.Read([], None, [])
    long = extract.read_message(attached(("Remark,NAV Date,Unit NAV\n" + '"' + "x, " * 100_000 + '",2026-01-09,1.01\n').encode()))
    assert len(long.rows) == 1


def test_parts_are_united_and_one_failure_fails_all():
    page = "<table><tr><th>NAV Date<th>Unit NAV<tr><td>2026-01-09<td>1.02</table>"
    assert sorted(r.unit for r in extract.read_message(table(html=page)).rows) == [1.01, 1.02]
    assert extract.read_message(table(html=page.replace("<td>", "<td rowspan=0>"))).rows == []
    assert extract.read_message(table(plain=None, html="<script>NAV: 3</script><p>NAV: 1.5<p>Date: 2026-01-09")).rows[0].unit == 1.5
    assert extract.read_message({}) == extract.Read([], None, [])
    arrays = extract.read_message({"subject": None, "plain": [table()["plain"], None], "html": []})
    assert len(arrays.rows) == 1


def test_limits_refuse(monkeypatch):
    monkeypatch.setattr(extract, "MOST_ROWS", 3)
    many = "NAV Date,Unit NAV\n" + "2026-01-09,1.01\n" * 4
    assert extract.read_message({"plain": many}).reason == "resource-limit"
    assert extract.read_message(attached(many.encode())).files == [("csv", "failed", "resource-limit")]
    monkeypatch.setattr(extract, "MOST_CHARS", 10)
    assert extract.read_message({"plain": many}).reason == "resource-limit"


def test_extractors_all_succeed_or_none(spark):
    good = (dt.date(2026, 1, 9), 1.01, None, "a-1")
    bad = {"odd-date": ("2026-01-09", 1.0, None, None), "odd-unit": (good[0], True, None, None), "odd-code": (good[0], 1.0, None, 7), "odd-range": (good[0], 1.0, -1.0, None), "odd-shape": 5}
    extract.register_extractor("good", lambda m: [good])
    extract.register_extractor("empty", lambda m: [])
    extract.register_extractor("broken", lambda m: 1 / 0)
    for name, row in bad.items():
        extract.register_extractor(name, lambda m, row=row: [row])
    messages = spark.createDataFrame([("m1", "s", table()["plain"]), ("m2", None, None)], "message_id string, subject string, plain string").repartition(2)
    both = extract.run_extractors(messages, ["auto", "good"]).collect()
    assert [(r.message_id, r.code, r.unit, r.source) for r in both] == [("m1", "A1", 1.01, "good")]
    assert [tuple(r) for r in extract.extractor_failures(messages, ["auto", "good"]).collect()] == [("m2", "auto: no-rows")]
    why = {n: extract.extractor_failures(messages, ["good", n]).first()["reason"] for n in ["empty", "broken", *bad]}
    assert why == {"empty": "empty: no-rows", "broken": "broken: failed: ZeroDivisionError", "odd-date": "odd-date: invalid-date", "odd-unit": "odd-unit: invalid-unit", "odd-code": "odd-code: invalid-code", "odd-range": "odd-range: invalid-cumulative", "odd-shape": "odd-shape: invalid-row"}
    for name in ("Bad name", "auto", ""):
        with pytest.raises(ValueError):
            extract.register_extractor(name, len)
    with pytest.raises(ValueError):
        extract.run_extractors(messages, ["nobody"])


def test_one_scan_for_all_extractors(spark, tmp_path):
    spark.createDataFrame([("m1", "s", table()["plain"])], "message_id string, subject string, plain string").write.parquet(str(tmp_path / "m"))
    extract.register_extractor("good", lambda m: [(dt.date(2026, 1, 9), 1.01, None, "a-1")])
    plan = extract.run_extractors(spark.read.parquet(str(tmp_path / "m")), ["auto", "good"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
