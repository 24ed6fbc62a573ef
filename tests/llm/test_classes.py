"""Classes of equal sets are confirmed; contexts that were never seen have no bigram weight."""

import pytest
from conftest import text
from pyspark.sql import functions as F

from frostline.llm import language_model, near_dedup


def test_classes_are_confirmed(spark):
    one = text(1, 30)
    rows = [(1, one), (2, one.upper()), (3, one.replace(" ", "\n")), (4, one), (5, text(2, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    signed = near_dedup.signatures(docs, 5, 10)
    false = signed.withColumn("fp1", F.lit(1).cast("long")).withColumn("fp2", F.lit(1).cast("long"))
    sets = false.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node"))
    with pytest.raises(RuntimeError, match="fingerprints"):
        near_dedup.check_classes(false, sets, docs, 5)


def test_unseen_contexts_leave_order_two_out():
    for rows in ([], [(0, language_model._NONE, -8, 5), (3, -4, -9, 20)]):
        w = language_model.without_context(language_model.learn_weights(rows, 0.01))
        assert w[0, 0] == 0 and abs(w.sum(axis=1) - 1).max() < 1e-12
