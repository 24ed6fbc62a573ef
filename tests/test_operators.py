"""Rules of the operators, on fixtures small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from frostline.functions.text import parse_probability, shortened, token
from frostline.operators import edges, evaluate, filters, graph, splits, stats
from frostline.operators.ids import dense_remap, numbered


def pairs(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_core_cascades(spark):
    # Dropping item 4 leaves user 3 with one item, whose departure leaves item 3 with one user.
    p = pairs(spark, [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 3), (3, 4)])
    assert rows(filters.iterative_core(p, 2, 2)) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert rows(filters.iterative_core(p, 1, 1)) == rows(p)


def test_numbering_is_total_and_dense(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = rows(numbered(df, "k", "id").select("rn", "k", "id"))
    assert [r[0] for r in got] == list(range(1, 1001))
    assert [(r[1], r[2]) for r in got] == sorted((i % 7, i) for i in range(1000))
    assert rows(dense_remap(spark.createDataFrame([(5,), (9,), (5,)], "x long"), "x", "n")) == [(5, 0), (5, 0), (9, 1)]


def test_visibility_repair_sees_earlier_moves(spark):
    parts = spark.createDataFrame([(1, 1, "train"), (2, 2, "val"), (1, 2, "val"), (3, 1, "test")], "user_id long, item_id long, part string")
    # User 2 isn't in train: its row moves, which makes item 2 visible for (1, 2).
    assert rows(splits.repair_visibility(parts)) == [(1, 1, "train"), (1, 2, "val"), (2, 2, "train"), (3, 1, "train")]


def test_warmup_needs_more_than_k0(spark):
    p = pairs(spark, [(u, 1) for u in range(5)] + [(u, 2) for u in range(6)])
    got = splits.warmup_support(p, "item_id", 5)
    assert {r["item_id"] for r in got.collect()} == {2}
    sizes = {r["part"]: r["n"] for r in got.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert 1 <= sizes["support"] <= 4 and sizes["val"] >= 1 and sizes["test"] >= 1


def test_splits_are_disjoint_and_visible(spark):
    p = pairs(spark, [(u, i) for u in range(40) for i in range(60) if (u * 7 + i * 13) % 5 < 2])
    s = splits.split_tables(p, "item_id", 5).cache()
    train = s.where("split = 'warm_train'")
    for part in ("val", "test"):
        for kind in ("warm", "warmup", "cold"):
            rest = s.where(F.col("split") == f"{kind}_{part}")
            assert rest.join(train, ["user_id", "item_id"]).isEmpty()
            assert rest.join(train, "user_id", "left_anti").isEmpty()
    assert s.where("split = 'cold_val'").join(train, "item_id").isEmpty()
    with pytest.raises(ValueError):
        splits.entity_groups(p, "item_id", k0=1)


def test_flat_groups(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 2), (1, 0.5, 3), (2, 0.7, 1)], "g long, x double, r int")
    from pyspark.sql import Window

    w = Window.partitionBy("g")
    scaled = lambda flat: [r[0] for r in df.select("g", "r", edges.group_minmax(F.col("x"), w, flat, F.col("r")).alias("s")).orderBy("g", "r").select("s").collect()]
    assert scaled(0.5) == [0.5] * 4
    assert scaled(1.0) == [1.0] * 4
    assert scaled("rank") == [1.0, 0.5, 0.0, 1.0]


@pytest.mark.parametrize(
    "form,expected",
    [
        ("a", [0.73, 0.73, 1.0, None, None, None, None]),
        ("b", [0.73, 0.73, 1.0, None, None, None, None]),
        ("c", [0.73, 0.73, 0.5, 0.5, 0.5, 0.5, 0.5]),
        ("d", [0.73, 0.73, 1.0, None, None, None, None]),
    ],
)
def test_probability_forms(spark, form, expected):
    texts = ["0.73", "p is 0.73.", "1.5 stars", "10", "N/A", "nan", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["p"] for r in df.select("i", parse_probability(F.col("t"), form, 0.5).alias("p")).orderBy("i").collect()]
    if form == "a" or form == "d":
        assert got[:2] == expected[:2] and got[3:] == expected[3:]
    else:
        assert got[:2] == expected[:2] and got[4:] == expected[4:]


def test_tokens_and_ellipsis(spark):
    df = spark.createDataFrame([("  Sci-Fi & Fantasy! ", "a  b\n c d e f g h")], "x string, y string")
    assert df.select(token(F.trim("x")), shortened(F.col("y"), 8)).first()[:] == ("sci_fi_fantasy", "a b c...")


def test_one_more_than_the_minimum(spark):
    scored = [(u, 1, "strict_cold", s) for u, s in enumerate([0.9, 0.8, 0.75, 0.3, 0.2])]
    df = spark.createDataFrame(scored, "user_id long, item_id long, entity_type string, score double")
    assert edges.kept_above(df, 0.7, 10, 2, True).count() == 4  # three at the threshold and one more
    assert edges.kept_above(df, 0.7, 10, 2, False).count() == 3
    assert edges.kept_above(df, 0.95, 10, 2, False).count() == 2


def test_tail_swap_one_for_one(spark):
    data = [(1, i, "warmup", 1 - i / 100, llm) for i, llm in enumerate([0.9, 0.9, 0.1, 0.2, 0.1, 0.8])]
    df = spark.createDataFrame(data, "user_id long, item_id long, entity_type string, emb double, llm double")
    got = {r["rank"]: (r["item_id"], r["swapped"]) for r in edges.tail_swap(df, 0.5, 2, 4).collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (5, True), 4: (3, False)}


def test_edge_weights_decay_and_sum(spark):
    df = spark.createDataFrame([(0,), (3,), (9,)], "d int")
    got = [r[0] for r in df.select(graph.edge_weight(F.lit(0.5), F.col("d"), 0.8, 1.0, 5)).collect()]
    assert got == pytest.approx([0.4, 0.4 * math.exp(-0.6), 0.4 * math.exp(-1)])
    base = pairs(spark, [(1, 1)])
    pseudo = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5)], "user_id long, item_id long, probability double")
    assert rows(graph.weighted_edges(base, pseudo, "item_id", 1.0, 0.0)) == [(1, 1, 2.0)]


def test_ranking_metrics(spark):
    topk = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "user_id long, item_id long, rank int")
    truth = pairs(spark, [(1, 10), (1, 12), (2, 5)])
    r = evaluate.ranking_metrics(topk, truth, 3).first()
    assert (r["users"], r["hits"]) == (2, 2)
    assert r["recall"] == pytest.approx(0.5) and r["precision"] == pytest.approx(1 / 3, abs=1e-6)
    assert r["ndcg"] == pytest.approx(0.5 * (1 + 0.5) / (1 + 1 / math.log2(3)), abs=1e-6)


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "score double, label int")
    assert evaluate.auc(df).first()["auc"] == pytest.approx(0.875)
    assert evaluate.auc(df.where("label = 1")).first()["auc"] is None


def test_bins_close_at_one(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.7, 1.0)], "x double")
    assert [r[0] for r in df.select(evaluate.bin_of(F.col("x"))).collect()] == [0, 3, 7, 9]


def test_paired_test(spark):
    values = [("a", s, v) for s, v in enumerate([2.0, 4.0, 6.0, 8.0, 10.0])] + [("b", s, float(s + 1)) for s in range(5)]
    m = spark.createDataFrame([(x, "overall", "recall", s, v) for x, s, v in values], "method string, split string, metric string, seed long, value double")
    declared = spark.createDataFrame([("overall", "recall", "b")], "split string, metric string, comparator string")
    r = stats.paired_test(m, "a", declared).first()
    assert r["n"] == 5 and r["p_value"] == pytest.approx(0.013236, abs=1e-6)
    with pytest.raises(Exception, match="seeds"):
        stats.paired_test(m.where("not (method = 'b' and seed = 4)"), "a", declared).collect()


def test_t_distribution(spark):
    # Known two-sided 5 % points of Student's t.
    table = {1: 12.7062, 2: 4.30265, 3: 3.18245, 4: 2.77645, 7: 2.36462, 10: 2.22814, 24: 2.06390}
    df = spark.createDataFrame([(t, n) for n, t in table.items()], "t double, n int")
    for r in df.select(stats.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.05, abs=1e-5)


def test_shard_sizes(spark):
    w = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "shard long, weight long")
    got = rows(stats.shard_sizes(10, w))
    assert [g[1] for g in got] == [3, 2, 5] and [g[2] for g in got] == [0, 3, 5]
