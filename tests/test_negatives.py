"""Negatives of every user, also of those who have met most items."""

from collections import defaultdict

from frostline.plans.data import drawn_negatives


def test_every_user_has_its_negatives(spark):
    met = {1: range(1, 3), 2: range(1, 21), 3: range(1, 36), 4: range(1, 41), 5: range(4, 5), 6: range(5, 14)}
    positives = [(u, i) for u, items in met.items() for i in items]
    items = spark.createDataFrame([(i,) for i in range(1, 41)], "item_id long")
    got = [tuple(r) for r in drawn_negatives(spark.createDataFrame(positives, "user_id long, item_id long"), items).collect()]
    by = defaultdict(set)
    for u, i in got:
        by[u].add(i)
    assert len(got) == len(set(got)) and not set(got) & set(positives)
    assert {u: len(by[u]) for u in met} == {u: min(len(m), 40 - len(m)) for u, m in met.items()}
    assert all(1 <= i <= 40 for _, i in got)
