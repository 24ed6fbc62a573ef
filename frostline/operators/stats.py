"""Repeated runs: summaries, paired tests, comparisons and choices on a long table of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the finite trigonometric series."""
    a = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.cos(a) * F.cos(a)
    odd = F.when(df == 1, F.lit(0.0)).otherwise(F.cos(a) * _series(cos2, F.lit(2.0), ((df - 3) / 2).cast("int")))
    even = _series(cos2, F.lit(1.0), ((df - 2) / 2).cast("int"))
    inside = F.when(df % 2 == 1, 2 / F.pi() * (a + F.sin(a) * odd)).otherwise(F.sin(a) * even)
    return 1 - inside


def _series(cos2: Column, first: Column, n: Column) -> Column:
    """1 + sum of n products of (first + 2j - 2) / (first + 2j - 1) times powers of cos2."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda s, j: F.struct((s["term"] * cos2 * (first + 2 * j - 2) / (first + 2 * j - 1)).alias("term"), (s["sum"] + s["term"] * cos2 * (first + 2 * j - 2) / (first + 2 * j - 1)).alias("sum"))
    return F.when(n < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda s: s["sum"]))


def seed_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation (0 for one seed) of (method, split, metric, seed, value)."""
    return metrics.groupBy("method", "split", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"))


def paired_test(metrics: DataFrame, target: str, comparators: DataFrame) -> DataFrame:
    """Two-sided paired t-test of a method with declared comparators (split, metric, comparator).

    Seeds must match, or it is an error; fewer than two seeds give null; equal values give 1.
    """
    a = metrics.where(F.col("method") == target).select("split", "metric", "seed", F.col("value").alias("a"))
    b = comparators.join(metrics.withColumnRenamed("method", "comparator"), ["split", "metric", "comparator"]).select("split", "metric", "comparator", "seed", F.col("value").alias("b"))
    both = a.join(comparators, ["split", "metric"]).join(b, ["split", "metric", "comparator", "seed"], "full_outer")
    checked = both.withColumn("d", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("seeds don't match"))).otherwise(F.col("a") - F.col("b")))
    g = checked.groupBy("split", "metric", "comparator").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.col("m") / (F.col("s") / F.sqrt("n"))
    p = F.when(F.col("n") < 2, F.lit(None)).when(F.col("s") == 0, F.when(F.col("m") == 0, 1.0).otherwise(0.0)).otherwise(t_two_sided(t, F.col("n") - 1))
    return g.select("split", "metric", "comparator", "n", F.round("m", 6).alias("mean_difference"), F.round(p, 6).alias("p_value"))


def best_by(rows: DataFrame, by: str, value: str, name: str, largest: bool = True) -> DataFrame:
    """The row of each group with the largest (or smallest) value; ties to the first name."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc() if largest else F.col(value), F.col(name))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def shard_sizes(total: int, weights: DataFrame) -> DataFrame:
    """Largest-remainder sizes of (shard, weight): whole parts first, then one each by falling fraction."""
    w = Window.partitionBy()
    exact = weights.withColumn("x", F.lit(total) * F.col("weight") / F.sum("weight").over(w)).withColumn("base", F.floor("x").cast("long"))
    rest = exact.withColumn("left", F.lit(total) - F.sum("base").over(w)).withColumn("r", F.row_number().over(Window.orderBy((F.col("x") - F.col("base")).desc(), "shard")))
    sized = rest.withColumn("size", F.col("base") + (F.col("r") <= F.col("left")).cast("long"))
    start = F.coalesce(F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.select("shard", "size", start.alias("start"))


def declared_test(metrics: DataFrame, target: str, comparators: DataFrame) -> DataFrame:
    """``paired_test`` where every cell (split, metric) of the target has a comparator declared beforehand.

    A cell without one, or with several, or a comparator without values there, is an error.
    """
    cells = metrics.where(F.col("method") == target).select("split", "metric").distinct()
    found = cells.join(comparators, ["split", "metric"], "left").join(metrics.select("split", "metric", F.col("method").alias("comparator"), F.lit(1).alias("_there")).distinct(), ["split", "metric", "comparator"], "left")
    wrong = found.groupBy("split", "metric").agg(F.count("*").alias("n"), F.count("_there").alias("there")).where("n <> 1 or there <> 1")
    if bad := wrong.limit(5).collect():
        raise ValueError(f"no single declared comparator with values: {[(r['split'], r['metric']) for r in bad]}")
    return paired_test(metrics, target, comparators)


def gains(metrics: DataFrame, target: str, factor: float = 1.05) -> DataFrame:
    """Per cell: the target's mean over the best other mean, less 1; whether it reaches ``factor`` times it, there and everywhere."""
    means = metrics.groupBy("method", "split", "metric").agg(F.avg("value").alias("v"))
    best = means.where(F.col("method") != target).groupBy("split", "metric").agg(F.max("v").alias("best"))
    cells = means.where(F.col("method") == target).join(best, ["split", "metric"])
    reaches = F.col("v") >= factor * F.col("best")
    everywhere = cells.agg(F.every(reaches).alias("everywhere"))
    return cells.join(F.broadcast(everywhere), F.lit(True)).select("split", "metric", F.round(F.col("v") / F.col("best") - 1, 6).alias("gain"), reaches.alias("reaches"), "everywhere")


def compared_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per cell: difference of means, relative difference, and a paired test over the seeds that both have."""
    keys = ["split", "metric"]
    mean = lambda df, n: df.groupBy(*keys).agg(F.avg("value").alias(n))
    both = new.select(*keys, "seed", F.col("value").alias("a")).join(old.select(*keys, "seed", F.col("value").alias("b")), [*keys, "seed"])
    g = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("m"), F.stddev_samp(F.col("a") - F.col("b")).alias("s"))
    t = F.col("m") / (F.col("s") / F.sqrt("n"))
    p = F.when(F.col("n") < 2, F.lit(None)).when(F.col("s") == 0, F.when(F.col("m") == 0, 1.0).otherwise(0.0)).otherwise(t_two_sided(t, F.col("n") - 1))
    cells = mean(new, "new").join(mean(old, "old"), keys).join(g, keys, "left")
    return cells.select(*keys, F.round(F.col("new") - F.col("old"), 6).alias("delta"), F.round(F.try_divide(F.col("new") - F.col("old"), F.col("old")), 6).alias("relative"), "n", F.round(p, 6).alias("p_value"))


def nearest_method(metrics: DataFrame, reference: str) -> DataFrame:
    """Methods by their mean absolute difference from a reference's values, cells without a value left out; ``best`` marks the nearest."""
    keys = ["split", "metric", "seed"]
    of = metrics.where(F.col("method") == reference).select(*keys, F.col("value").alias("r"))
    far = metrics.where(F.col("method") != reference).join(of, keys).groupBy("method").agg(F.avg(F.abs(F.col("value") - F.col("r"))).alias("d"), F.count(F.col("value") - F.col("r")).alias("cells"))
    least = far.agg(F.min(F.struct("d", "method")).alias("least"))
    return far.join(F.broadcast(least), F.lit(True)).select("method", "cells", F.round("d", 6).alias("distance"), (F.col("method") == F.col("least.method")).alias("best"))


def margin_choice(metrics: DataFrame, thresholds: dict[str, float], by: str = "method", run: str = "seed") -> DataFrame:
    """The run of each group with the greatest least margin over thresholds; ties by the sum of margins, then the first run."""
    over = F.lit(None).cast("double")
    for metric, least in thresholds.items():
        over = F.when(F.col("metric") == metric, F.col("value") - least).otherwise(over)
    runs = metrics.where(F.col("metric").isin(*thresholds)).groupBy(by, run).agg(F.round(F.min(over), 9).alias("margin"), F.round(F.sum(over), 9).alias("total"))
    w = Window.partitionBy(by).orderBy(F.col("margin").desc(), F.col("total").desc(), F.col(run))
    return runs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(by, run, F.round("margin", 6).alias("margin"))
