"""Columns of any name and type beside the documents', and ids with several texts."""

import corpus_pipeline
import pytest
from conftest import text
from pyspark.sql import functions as F

from frostline.llm import mixing, surrogates

KEY = b"k"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    """Nested names with hyphens, names that the operators use themselves, dots and backticks."""
    rows = [(k, f"Mr Ivan Name{chr(97 + k % 26)} has {1000000000 + k % 7} {text(k, 8)}", "s") for k in range(30)] + [(90, None, "s"), (91, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.withColumn("meta", F.struct(F.lit(1).alias("a-b"), F.array(F.struct(F.lit("x").alias("c d"))).alias("e.f")))
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(["_h", "_again", "entities", "other", "_key", "a.b", "c`d", "_row", "_id", "h", "kind"])])


@pytest.mark.parametrize("most", [-1, 100_000])
def test_surrogates_beside_odd_columns(spark, odd, most):
    got = surrogates.with_surrogates(odd, KEY, most_exceptions=most, column="_h" if most < 0 else "entities")
    gone = "_h" if most < 0 else "entities"
    assert got.columns == [c for c in odd.columns if c != gone] + [gone]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == 32 and rows[90]["text"] is None and rows[91]["text"] == ""
    for r in odd.collect():
        assert all(r[c] == rows[r["doc_id"]][c] for c in odd.columns if c not in ("text", gone)) and rows[r["doc_id"]]["meta"]["a-b"] == 1
    assert surrogates.with_surrogates(odd.limit(0), KEY, most_exceptions=most).count() == 0


def test_stages_keep_odd_columns(spark, odd, tmp_path):
    for name in ("near_dedup", "pii", "mixing"):
        out = STAGES[name](spark, odd, str(tmp_path))
        assert out.columns == odd.columns and out.count() >= 1
    assert mixing.mixed_documents(odd).schema["meta"].dataType == odd.schema["meta"].dataType


def test_ids_with_several_texts(spark):
    """Each text of an id is a document; rows that are equal stand once, rows without an id stay."""
    a, b, c = text(1, 80), text(2, 80), text(3, 80)
    near = " ".join([*a.split()[:40], "changed", *a.split()[41:]])
    rows = [(1, a, "x"), (3, near, "y"), (3, b, "z"), (3, b, "z"), (4, b, "w"), (5, c, "v"), (5, None, "u"), (None, a, "t"), (None, a, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.lit(7).alias("_row"), F.lit(8).alias("_id"))
    got = sorted(map(tuple, STAGES["near_dedup"](spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a, "x", 7, 8), (3, b, "z", 7, 8), (5, c, "v", 7, 8), (5, None, "u", 7, 8), (None, a, "t", 7, 8), (None, a, "t", 7, 8)], key=str)


def test_more_kinds():
    t = "Tel. 030 123456, fax: (0221) 47-11, at 2001:db8::ff00:42:8329 or FE80:0:0:0:202:B3FF:FE1E:8329, passport no. C01X00T47; 12:30:45 and a::b stay. ANNA SCHMIDT wrote, Anna Schmidt read."
    kinds = [(k, t[a:b]) for a, b, k in surrogates.entities(t)]
    assert kinds[:5] == [("phone", "030 123456"), ("phone", "(0221) 47-11"), ("ip6", "2001:db8::ff00:42:8329"), ("ip6", "FE80:0:0:0:202:B3FF:FE1E:8329"), ("passport", "C01X00T47")]
    assert [v for _, v in kinds[5:]] == ["ANNA", "SCHMIDT", "Anna", "Schmidt"]
    new, found = surrogates._replaced(t, KEY, {})
    made = [f["surrogate"] for f in found]
    assert "12:30:45 and a::b stay" in new and not any(v in new for _, v in kinds) and made[5].isupper() and made[5].lower() == made[7].lower() and made[6].lower() == made[8].lower()
    assert [len(m) for m in made[:5]] == [len(v) for _, v in kinds[:5]] and ":" in made[2]


def test_a_process_keeps_things_of_one_operator():
    from frostline.llm import common

    before = dict(common._KEPT)
    try:
        one = common.kept("x", 1, lambda: [1])
        assert common.kept("x", 1, lambda: [2]) is one and common.kept("x", 2, lambda: [3]) == [3] and common.kept("x", 1, lambda: [4]) == [4]
        assert common.kept("y") is None and common.kept("x", 1, lambda: [5]) == [5]
    finally:
        common._KEPT.clear()
        common._KEPT.update(before)
