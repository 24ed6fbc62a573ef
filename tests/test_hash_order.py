"""The first rows by hash, told by counts, against a sort; ties and edges."""

import pytest
from pyspark.sql import functions as F

from frostline.operators.ids import HashOrder, hash_order


@pytest.mark.parametrize("order", ["hash", "few", "one"])
def test_first_rows(spark, order):
    rows = [(a, b) for a in range(40) for b in range(a % 9)]
    frame = spark.createDataFrame(rows, "a long, b long").repartition(4).cache()
    column = {"hash": hash_order(F.concat_ws("-", "a", "b"), 3), "few": (F.col("a") % 5).cast("long") * 70_000, "one": F.lit(7).cast("long")}[order]
    every = sorted((r.x, r.a, r.b) for r in frame.select("a", "b", column.alias("x")).collect())
    found = HashOrder(frame, column, "a", "b")
    ns = [0, 1, 2, 17, len(rows) // 2, len(rows) - 1, len(rows), len(rows) + 5]
    assert found.n == len(rows)
    for n, condition in zip(ns, found.first(*ns)):
        assert sorted(map(tuple, frame.where(condition).collect())) == sorted(r[1:] for r in every[:n])


def test_no_rows(spark):
    none = spark.createDataFrame([], "a long")
    assert HashOrder(none, hash_order(F.col("a"), 1), "a").n == 0 and none.where(HashOrder(none, hash_order(F.col("a"), 1), "a").first(3)[0]).count() == 0
