"""The mailbox source: push-down, resumed streams, admission by bytes, rows read once."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.sources import mailbox

T0 = dt.datetime(2026, 1, 1)


def store(path, boxes=("a", "b"), n=60, first=0):
    for k, box in enumerate(boxes):
        (path / box).mkdir(parents=True, exist_ok=True)
        uids = list(range(first + 1, first + n + 1))
        table = pa.table(
            {
                "message_id": [f"{box}{u}" for u in uids],
                "uid": pa.array(uids, pa.int64()),
                "from_raw": [f"Desk <desk{u % 3}@example.com>" if u % 7 else "a@example.com, b@example.com" for u in uids],
                "subject": ["NAV"] * n,
                "sent_at": pa.array([T0 + dt.timedelta(days=u) for u in uids], pa.timestamp("us")),
                "size": pa.array([100 + k if u % 10 else 5000 for u in uids], pa.int64()),
                "plain": [[f"text {u}"] for u in uids],
            }
        )
        pq.write_table(table.take(pa.array(sorted(range(n), key=lambda i: (i // 20, -i)))), path / box / f"part-{first}.parquet", row_group_size=20)
    return path


@pytest.fixture(scope="module")
def source(spark):
    mailbox.register(spark)
    return spark


def test_read_with_conditions(source, tmp_path):
    path = str(store(tmp_path))
    df = source.read.format("mailbox").load(path)
    assert df.count() == 120
    got = df.where((F.col("sender") == "desk1@example.com") & (F.col("sent_at") >= F.lit("2026-02-20").cast("timestamp")) & (F.col("mailbox") == "b")).select("message_id", "plain", "html").collect()
    assert sorted(r.message_id for r in got) == sorted(f"b{u}" for u in range(1, 61) if u % 3 == 1 and u % 7 and u >= 50)
    assert all(r.plain and r.html is None for r in got)
    assert df.where("uid > 1000").count() == 0
    assert df.where("sender is null").count() == 2 * len([u for u in range(1, 61) if u % 7 == 0])


def test_conditions_prune_row_groups(tmp_path):
    store(tmp_path)
    reader = mailbox.Reader({"path": str(tmp_path)}, mailbox.SCHEMA)
    left = list(reader.pushFilters([mailbox.GreaterThan(("uid",), 40), mailbox.EqualTo(("mailbox",), "a"), mailbox.EqualTo(("subject",), "NAV")]))
    assert [f.attribute for f in left] == [("subject",)]
    assert [(g.mailbox, g.number) for g in reader.partitions()] == [("a", 2)]


def run(spark, path, base, **options):
    stream = spark.readStream.format("mailbox").options(progress=f"{base}/progress", **options).load(str(path))
    out = stream.select("mailbox", "uid", "sender", "size").writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    out.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    return [(r.mailbox, r.uid) for r in spark.read.parquet(f"{base}/rows").collect()]


def test_a_stopped_stream_goes_on_and_reads_every_row_once(source, tmp_path):
    path, base, seen = store(tmp_path / "store"), tmp_path / "run", []
    sizes = []
    while True:
        now = run(source, path, base, max_bytes=1000, max_bytes_each=4000)
        if len(now) == len(seen):
            break
        sizes.append(len(now) - len(seen))
        seen = now
    assert sorted(seen) == sorted((b, u) for b in "ab" for u in range(1, 61) if u % 10)
    assert len(seen) == len(set(seen)) and max(sizes) <= 2 * 10 and len(sizes) >= 6
    store(tmp_path / "store", n=5, first=60)  # new mail
    assert sorted(set(run(source, path, base, max_bytes=1000)) - set(seen)) == [(b, u) for b in "ab" for u in range(61, 66)]


def test_a_failed_batch_is_read_again(source, tmp_path):
    path, base = store(tmp_path / "store", n=10), tmp_path / "run"
    fail = {"on": True}

    def sink(batch, number):
        if fail["on"]:
            raise RuntimeError("stopped")
        batch.write.mode("append").parquet(f"{base}/rows")

    for _ in range(3):
        stream = source.readStream.format("mailbox").options(progress=f"{base}/progress", max_messages="4").load(str(path)).select("mailbox", "uid")
        job = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
        try:
            job.awaitTermination()
        except Exception:  # the sink's
            assert fail["on"]
        fail["on"] = False
    got = [(r.mailbox, r.uid) for r in source.read.parquet(f"{base}/rows").collect()]
    assert len(got) == len(set(got)) >= 8 and ("a", 1) in got


def test_one_message_is_always_admitted(tmp_path):
    store(tmp_path, n=10)
    reader = mailbox.StreamReader({"path": str(tmp_path), "max_bytes": "1"}, mailbox.SCHEMA)
    assert reader.latestOffset() == {"a": 1, "b": 1}
