"""The commit log: one winner among writers, entries put once, batches appended once."""

import threading

import pytest

from tidemark.sources import snapshots


def test_put_if_absent_has_one_winner(spark):
    path = snapshots.fresh_path(spark, "entries")
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append((i, snapshots.put_if_absent(spark, f"{path}/log/1.json", f'{{"i": {i}}}')))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = [i for i, ok in won if ok]
    assert len(winner) == 1 and len(won) == 8
    assert [r["i"] for r in spark.read.schema("i long").json(f"{path}/log").collect()] == winner  # nothing is left aside


def test_two_writers_at_one_base(spark):
    path = snapshots.fresh_path(spark, "versions")
    first = spark.createDataFrame([(1,)], "k long")
    snapshots.publish_version(first, path, None, keep=3)
    base, results = snapshots.current_fingerprint(spark, path), []

    def write(n):
        try:
            results.append(snapshots.publish_version(spark.createDataFrame([(1,), (n,)], "k long"), path, base, keep=3))
        except ValueError as e:
            results.append(str(e))

    threads = [threading.Thread(target=write, args=(n,)) for n in (2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [r for r in results if isinstance(r, int)] == [2] and len(results) == 3
    assert snapshots.read_published(spark, path).count() == 2
    files, where = snapshots.files_at(spark, f"{path}/data")
    assert len(files.listStatus(where)) == 2  # what lost is gone
    with pytest.raises(ValueError):
        snapshots.publish_version(first, path, None, keep=3)


def test_old_versions_go(spark):
    path = snapshots.fresh_path(spark, "versions")
    for n in range(4):
        snapshots.publish_version(spark.range(n + 1), path, snapshots.current_fingerprint(spark, path), keep=2)
    assert sorted(r["version"] for r in snapshots.versions(spark, path).collect()) == [3, 4]
    assert snapshots.read_published(spark, path).count() == 4


def test_a_replayed_batch_reads_nothing(spark):
    path, calls = snapshots.fresh_path(spark, "appended"), []

    def fresh(batch):
        calls.append(1)
        return batch

    rows = spark.range(3)
    assert snapshots.appended_rows(spark, path, "id long").count() == 0
    assert snapshots.append_batch(rows, path, "s", 0, fresh)
    assert not snapshots.append_batch(rows, path, "s", 0, fresh)
    assert len(calls) == 1 and snapshots.appended_rows(spark, path, "id long").count() == 3
    # a batch that failed before its entry is written again, whole
    spark.range(2).write.parquet(f"{path}/batches/s-{1:012d}")
    assert snapshots.append_batch(rows, path, "s", 1, fresh)
    assert snapshots.appended_rows(spark, path, "id long").count() == 6
