"""What is sent between tasks: lists come together once, features are made where they lie."""

from pyspark.sql import functions as F

from frostline.operators import calibration, edges
from frostline.plans import pools
from frostline.sources.storage import stored


def _lists(spark):
    rows = spark.range(0, 400).select((F.col("id") % 5).alias("user_id"), F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, "warmup").otherwise("strict_cold").alias("entity_type"))
    return rows.select("*", (F.xxhash64("item_id") % 1000 / 1000.0).alias("score"), F.expr("row_number() over (partition by entity_type, user_id order by xxhash64(item_id) desc)").alias("rank"))


def _exchanges(df):
    # The plan as it is before any stage has run.
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in line and "Broadcast" not in line]


def test_fused_variants_send_each_list_once(spark):
    one = stored(_lists(spark).where("rank <= 30"))
    found = edges.fused_variants(one, one, pools.VARIANTS, pools._KS, 30)
    assert len(_exchanges(found)) == 1
    assert found.select("variant").distinct().count() == len(pools.VARIANTS)


def test_features_are_not_sent_once_they_are_made(spark):
    rows = stored(_lists(spark).select("user_id", "item_id", "entity_type", "score", (F.col("item_id") % 2).alias("label")))
    found = edges.nine_features(rows, rows.groupBy("item_id").agg(F.count("*").alias("pop")), keep=("label",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan[: plan.index("Window ")].splitlines() if "Exchange hashpartitioning" in x]
    assert found.where("label = item_id % 2").count() == 400


def test_training_rows_that_are_all_kept_are_not_moved_or_stored_again(spark):
    rows = stored(_lists(spark).select("user_id", "item_id", "entity_type", (F.col("item_id") % 2).cast("int").alias("label")))
    all_kept = calibration.training_rows(rows, multiplier=2, least=0)
    assert not hasattr(all_kept, "_stored_at") and not _exchanges(all_kept) and all_kept.count() == 400
    # All of 67 warm-up positives and the first 33 negatives, by hash.
    some = calibration.training_rows(rows.where("item_id % 2 = 1 or item_id < 200"), multiplier=0, least=33).groupBy("entity_type", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    n = {(r.entity_type, r.label): r.n for r in some}
    assert n[("warmup", 0)] == n[("strict_cold", 0)] == 33 and n[("warmup", 1)] + n[("strict_cold", 1)] == 200
    assert all(abs(r.w - (33 + n[(r.entity_type, 1)]) / 2) < 1e-9 for r in some)


def test_reranked_takes_the_rows_own_labels(spark):
    rows = _lists(spark).select("user_id", "item_id", "entity_type", F.col("score").alias("scaled"), (1 / F.col("rank")).alias("inverse_rank"), (F.col("item_id") % 4 == 0).cast("int").alias("label"))
    rows = stored(rows)
    own = calibration.reranked(rows, None, ["scaled", "inverse_rank"], least=10)
    other = calibration.reranked(rows.drop("label"), rows.where("label = 1"), ["scaled", "inverse_rank"], least=10)
    near = lambda df: {(r.user_id, r.item_id): round(r.probability, 9) for r in df.collect()}
    assert near(own) == near(other) and len(near(own)) == 400
