"""Queries over tables with greater keys, sparser dates and longer texts than the smallest tables have."""

import csv
import datetime as dt
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, QUERIES
from tidemark.functions import scalars
from tidemark.operators import extract, filters, routing
from tidemark.plans import sheet_queries
from tidemark.sources import mailbox
from tidemark.streaming import jobs
from tests.test_oracle import spelt


def both(spark, name, folder, *tables):
    """The rows of a query and of its SQL over tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, result = QUERIES[name](spark, str(folder)), con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    return spelt(df.collect(), sorted(names)), spelt([dict(zip(names, r, strict=True)) for r in result.fetchall()], sorted(names))


class FakeState:
    def __init__(self):
        self.rows, self.writes = None, 0

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.writes = rows, self.writes + 1


def test_a_buckets_codes_are_written_together():
    class Handle:
        state, timers = FakeState(), []

        def getListState(self, name, schema):  # noqa: N802
            return self.state

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Timers:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 10

    job, handle = jobs.Corrections(), Handle()
    job.init(handle)
    rows = pd.DataFrame([("A", 20, 2, 2.0, "error"), ("A", 20, 1, 1.0, "view"), ("B", 20, 3, 5.0, "view"), ("C", 9, 4, 5.0, "view")], columns=["code", "at", "event_id", "value", "event_type"])
    told = pd.concat(job.handleInputRows(("2026-01-01", 7), iter([rows]), Timers())).set_index("code")
    assert [told.loc["A", c] for c in ("unit", "conflict", "n", "late")] == [2.0, False, 2, 0]
    assert told.loc["B", "n"] == 1 and told.loc["C", "n"] == 0 and told.loc["C", "late"] == 1
    again = pd.DataFrame([("B", 20, 5, 6.0, "view")], columns=rows.columns)
    told = pd.concat(job.handleInputRows(("2026-01-01", 7), iter([again]), Timers())).set_index("code")
    assert told.loc["B", "conflict"] and told.loc["B", "n"] == 2
    assert handle.state.writes == 2 and len(handle.timers) == 1 and sorted(r[0] for r in handle.state.rows) == ["A", "B"]


def test_texts_beyond_the_limit_are_not_made(spark, tmp_path):
    rows = [(1, "x" * 100_000), (4, "ab"), (6, "x\n" * 40_000), (2, "y"), (3, "y"), (5, "a\nb"), (14, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.reject for r in QUERIES["b13_resource_guard"](spark, str(tmp_path)).collect()}
    assert got == {1: "too many characters", 4: "too many characters", 6: "too many rows", 2: "too many columns", 3: "too many tables", 5: None, 14: None}
    declared = spark.createDataFrame([(None, 2_000_001), ("a", 1)], "t string, n long")
    assert [r.reject for r in filters.resource_guard(declared, "t", "n").collect()] == ["too many characters", None]


def test_pairs_of_routes_are_not_shuffled(spark):
    m = spark.createDataFrame([("m1", "a", "nav x"), ("m2", "a", "report"), ("m3", "a", "nav x"), ("m4", "b", "nav")], "message_id string, sender string, subject string")
    r = spark.createDataFrame([("s1", "a", None), ("s2", "a", "nav"), ("s3", "a", None), ("s1", "b", None), ("s3", "b", "nav")], "sheet string, sender string, subject_contains string")
    pairs = routing.route_overlaps(m, r, spread=4)
    assert sorted(map(tuple, pairs.collect())) == [
        ("s1", "s2", "subject", 2, ["m1", "m3"]), ("s1", "s3", "sender", 3, ["m1", "m2", "m3"]), ("s1", "s3", "subject", 1, ["m4"]), ("s2", "s3", "subject", 2, ["m1", "m3"]),
    ]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any(word in line for line in plan[: next(i for i, x in enumerate(plan) if "Join" in x)] for word in ("Aggregate", "Repartition"))


def test_a_history_without_third_days(spark, tmp_path):
    days = [dt.datetime(1999, 3, d) for d in (8, 16, 25)]
    rows = [(1, k, 100.0 + i, 2.0, d) for k in range(6) for i, d in enumerate(days)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = both(spark, "h5_pending_week", tmp_path, "lineitem")
    assert len(got) == 6 and got == want


@pytest.mark.parametrize("name", ["f1_route_conditions", "g3_route_report"])
def test_codes_of_five_digits(spark, tmp_path, name):
    kinds = ("view", "click", "signup", "purchase", "error")
    users = [u for k in (10231, 10369, 10307, 10457, 10338, 12, 81) for u in (k, k + 10, k + 1)]
    rows = [(i, dt.datetime(2024, 1, 1 + i % 28, i % 24), users[i % len(users)], kinds[i % 5], 1.0 + i % 3, "{}") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, name, tmp_path, "events")
    assert got and got == want


def test_payloads_are_read_by_bytes(spark):
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4], "b": [b"x" * 60, b"y" * 60, None, b"z" * 30]})
    assert [s.column(0).to_pylist() for s in extract.by_bytes(batch, 1, 100)] == [[1], [2, 3, 4]]
    rows = spark.createDataFrame([(1, b"a,b\n1,2"), (2, None), (3, b"\xff\x81\xff")], "k long, b binary")
    got = sorted((r.k, r.row, r.cells) for r in extract.read_delimited_payloads(rows, "k", "b").collect())
    assert got == [(1, 1, ["a", "b"]), (1, 2, ["1", "2"]), (2, None, None), (3, None, None)]


def test_a_row_group_is_read_in_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(mailbox, "AT_A_TIME", 10)
    (tmp_path / "a").mkdir()
    n = 95
    table = pa.table({"message_id": [f"m{i}" for i in range(n)], "uid": list(range(n)), "from_raw": ["A <a@example.com>"] * n, "sent_at": [dt.datetime(2026, 1, 1)] * n, "size": [1] * n})
    pq.write_table(table, tmp_path / "a" / "x.parquet")
    store = mailbox.Store(str(tmp_path))
    group = store.groups("a")[0]
    group.after, group.upto = 4, 89
    parts = list(mailbox.taken(store, group, ["mailbox", "uid", "sender"], [("size", "not above", 5)]))
    assert max(p.num_rows for p in parts) <= 10
    assert [u for p in parts for u in p.column("uid").to_pylist()] == list(range(5, 90))
    assert {s for p in parts for s in p.column("sender").to_pylist()} == {"a@example.com"}


def test_a_date_takes_few_patterns(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("s")).select(scalars.parse_date("s"))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("regexp") + plan.count("rlike") <= 20  # twice each: with the name of the column


def test_a_dialect_without_the_sniffer(monkeypatch):
    rng, texts = random.Random(3), ["", "a", "a,b\n1,2", "Code | NAV Date\nS1 | 2020-01-01\nS2 | 2020-01-02", "a;b\r\n1;2\r\n", "x\x7fy\nz\x7fw", "é b\né c"]
    for _ in range(400):
        d = rng.choice([",", ", ", ";", "\t", " | ", ":", "x"])
        lines = [d.join(rng.choice(["a", "12", "b c", "", "2020-01-01"]) for _ in range(3 if rng.random() < 0.95 else 2)) for _ in range(rng.randint(1, 40))]
        texts += ["\n".join(lines), "".join(rng.choice("ab,; \n\n") for _ in range(rng.randint(1, 60)))]

    def library(text):
        try:
            d = csv.Sniffer().sniff(text)
        except csv.Error:
            return None
        return {"delimiter": d.delimiter, "doublequote": d.doublequote, "skipinitialspace": d.skipinitialspace}

    want = [library(t) for t in texts]
    calls = []
    monkeypatch.setattr(csv.Sniffer, "sniff", lambda self, text: calls.append(text) or csv.excel)
    assert [extract.even_dialect(t) for t in texts] == want
    assert extract.delimited_table("a;b\n1;2\n") == [["a", "b"], ["1", "2"]] and not calls
    assert extract.delimited_table("'a','b'") and calls == ["'a','b'"]


def test_rows_of_other_dates_are_not_rounded(monkeypatch):
    rows = [extract.Row(dt.date(2020, 1, i), 1.0 + i, None, "A", "csv") for i in (1, 2)]
    again = extract.Row(dt.date(2020, 1, 1), 2.0 + 1e-14, None, "A", "html")
    assert extract.distinct([*rows, again]) == [again, rows[1]]
    monkeypatch.setattr(extract, "round", None, raising=False)
    assert extract.distinct(rows) == rows


def test_notices_are_read_in_many_tasks(spark):
    """A union's small partitions are joined to few tasks unless they are dealt by a number; events need no join."""
    sf = "/root/testdata/sf0.001"
    plan = sheet_queries.labelled_pages(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" in plan
    for made in (sheet_queries.notices, sheet_queries.pages):
        assert "RepartitionByExpression" in made(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    df = QUERIES["d6_extract_observations"](spark, sf)
    assert df.rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
