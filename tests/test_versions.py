"""Changed ranges by descent of digest trees equal a comparison of all cells."""

import random

from pyspark.sql import functions as F

from tidemark.operators import versions


def test_ranges_equal_a_whole_comparison(spark, monkeypatch):
    monkeypatch.setattr(versions, "BLOCK_ROWS", 4)
    monkeypatch.setattr(versions, "FANOUT", 3)
    r = random.Random(1)
    old = {(s, row, col): str(r.randint(0, 9)) for s, n in (("a", 100), ("b", 30), ("same", 50), ("gone", 5)) for row in range(1, n + 1) for col in (1, 2)}
    new = {k: v for k, v in old.items() if k[0] != "gone"}
    for row in (4, 5, 6, 50, 99):
        new["a", row, 1] = "x"
    for row in range(31, 200):
        new["b", row, 1] = "more"
    del new["b", 1, 2]
    new["added", 7, 1] = "y"
    table = lambda d: spark.createDataFrame([(*k, "value", v) for k, v in d.items()], "sheet string, row int, col int, kind string, value string").repartition(3)
    a, b = table(old), table(new)
    blocks = versions.differing_blocks(versions.digest_tree(a), versions.digest_tree(b))
    rows: dict = {}
    for s, row, col in {*old, *new}:
        if old.get((s, row, col)) != new.get((s, row, col)):
            rows[s, row] = rows.get((s, row), 0) + 1
    assert {(x.sheet, x.block) for x in blocks.collect()} == {(s, (row - 1) // 4) for s, row in rows}
    want, run = [], None
    for (s, row), n in sorted(rows.items()):
        if run and run[0] == s and run[2] == row - 1:
            run[2], run[3] = row, run[3] + n
        else:
            run = [s, row, row, n]
            want.append(run)
    got = [tuple(x) for x in versions.changed_ranges(a, b, blocks).collect()]
    assert sorted(got) == sorted(map(tuple, want))
    same = versions.differing_blocks(versions.digest_tree(a), versions.digest_tree(a.orderBy(F.desc("row"))))
    assert same.count() == 0 and versions.changed_ranges(a, a, same).count() == 0
