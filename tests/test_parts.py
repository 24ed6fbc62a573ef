"""Evaluations by parts: what is searched for all items together comes from the parts' own searches."""

import os

import pytest

from frostline.plans import base, reports

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("query", ["eval_four_way", "topk_eval_user_cold"])
def test_each_item_meets_each_user_once(spark, monkeypatch, query):
    met = []
    none = spark.createDataFrame([], "target long, entity long, score double, candidate_rank int")
    monkeypatch.setattr(reports.C, "top_candidates", lambda users, items, seen, m: (met.append(users.count() * items.count()), none)[1])
    base.QUERIES[query](spark, DATA)
    assert sum(met) == base.user_vectors(spark, DATA).count() * base.item_vectors(spark, DATA).count()
