"""What steps over a graph store, and sums of rows that are there once."""

import numpy as np
from pyspark.sql import functions as F

from frostline.operators import factors, folds, models


def _edges(spark):
    return spark.range(0, 60).select((F.col("id") % 7).alias("user_id"), (F.col("id") % 11).alias("item_id"), F.lit(0.1).alias("w"))


def _nodes(spark):
    rows = [("u", k, [float(k), 1.0]) for k in range(7)] + [("i", k, [0.5, float(k)]) for k in range(11)]
    return spark.createDataFrame(rows, "side string, id long, v array<double>")


def test_one_layer_stores_no_vectors(spark, monkeypatch):
    kept = []
    for module in (folds, factors):
        was = module.stored
        monkeypatch.setattr(module, "stored", lambda df, was=was: kept.append(df.columns) or was(df))
    one = {(r.side, r.id): r.v for r in factors.propagated(_edges(spark), _nodes(spark), 1).collect()}
    assert not [c for c in kept if "v" in c]
    two = {(r.side, r.id): r.v for r in factors.propagated(_edges(spark), _nodes(spark), 2).collect()}
    assert len([c for c in kept if "v" in c]) == 1
    a = np.zeros((7, 11))
    for r in _edges(spark).collect():
        a[r.user_id, r.item_id] += r.w
    u, i = np.array([[float(k), 1.0] for k in range(7)]), np.array([[0.5, float(k)] for k in range(11)])
    for got, layers in ((one, 1), (two, 2)):
        us, is_ = [u], [i]
        for _ in range(layers):
            us, is_ = us + [a @ is_[-1]], is_ + [a.T @ us[-1]]
        for side, want in (("u", sum(us)), ("i", sum(is_))):
            assert all(np.allclose(got[(side, k)], x / (layers + 1)) for k, x in enumerate(want))


def test_sums_without_a_first_round(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (1, [10.0, 20.0]), (3, None)], "key long, v array<double>").repartition(3)
    got = {r.key: (r.n, r.v) for r in models.summed_vectors(rows, "key", partial=False).collect()}
    assert got == {1: (2, [11.0, 22.0]), 2: (1, [3.0, 4.0])}


def test_blocks_of_factorisation_grow_with_the_ratings(spark, monkeypatch):
    assert [models.als_blocks(n) for n in (0, 40_000_000, 40_000_001, 216_000_000)] == [10, 10, 11, 54]
    monkeypatch.setattr(models, "RATINGS", 20)
    found = models.factorised(_edges(spark).withColumn("item_id", F.col("item_id") + F.col("user_id") % 2).distinct().union(_edges(spark)), rank=2, rounds=1)
    assert found.userFactors.count() == 7
