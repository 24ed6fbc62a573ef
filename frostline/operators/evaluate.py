"""Ranking metrics, candidate pools, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.operators.ids import running_total

def ranking_metrics(topk: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean recall, precision and NDCG at k over users with truth: topk (user_id, item_id, rank)."""
    hits = topk.where(F.col("rank") <= k).join(truth.distinct(), ["user_id", "item_id"]).groupBy("user_id").agg(F.count("*").alias("h"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    users = truth.distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    each = users.join(hits, "user_id", "left").select("n", F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("dcg", F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    return each.agg(
        F.count("*").alias("users"), F.sum("h").alias("hits"), F.round(F.avg(F.col("h") / F.col("n")), 6).alias("recall"), F.round(F.avg(F.col("h") / F.lit(k)), 6).alias("precision"), F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg")
    )


def hit_stats(candidates: DataFrame, truth: DataFrame, by: str) -> DataFrame:
    """Pairs of truth found among candidates, and entities with any: counts and rates."""
    c = candidates.select("user_id", "item_id").distinct().withColumn("hit", F.lit(1))
    t = truth.select("user_id", "item_id").distinct().join(c, ["user_id", "item_id"], "left")
    e = t.groupBy(by).agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    return e.agg(
        F.sum("n").alias("pairs"), F.sum("h").alias("hits"), F.count("*").alias("entities"), F.sum((F.col("h") > 0).cast("long")).alias("entities_hit"),
        F.round(F.try_divide(F.sum("h"), F.sum("n")), 6).alias("pair_recall"), F.round(F.avg((F.col("h") > 0).cast("double")), 6).alias("entity_hit_rate"),
    )


def pool_oracle(pool: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """What the best order of a pool could reach: recall and NDCG at k, and the pool's pair recall."""
    users = truth.distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    found = pool.select("user_id", "item_id").distinct().join(truth.distinct(), ["user_id", "item_id"]).groupBy("user_id").agg(F.count("*").alias("h"))
    each = users.join(found, "user_id", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    gain = lambda n: F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))).otherwise(0.0)
    best = F.least(F.col("h"), F.lit(k))
    return each.agg(
        F.count("*").alias("users"), F.round(F.avg(best / F.col("n")), 6).alias("oracle_recall"), F.round(F.avg(gain(best) / gain(F.least(F.col("n"), F.lit(k)))), 6).alias("oracle_ndcg"), F.round(F.sum("h") / F.sum("n"), 6).alias("pair_recall")
    )


def auc(scored: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve of (score, label 0/1), of each group, with mean ranks for ties; null with one class.

    Ranks come from counts by distinct score and their running total over ranges of scores, so that no
    task sees all rows.
    """
    each = running_total(scored.groupBy(*by, "score").agg(F.count("*").alias("n"), F.sum("label").alias("p")), "n", *by, "score")
    ranked = each.withColumn("mean_rank", F.col("before") + (F.col("n") + 1) / 2)
    total = ranked.groupBy(*by).agg(F.sum("p").alias("pos"), F.sum("n").alias("n"), F.sum(F.col("mean_rank") * F.col("p")).alias("s"), F.min("before").alias("first"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    area = (F.col("s") - F.col("first") * pos - pos * (pos + 1) / 2) / (pos * neg)
    return total.select(*by, pos.cast("long").alias("positives"), neg.cast("long").alias("negatives"), F.when((pos > 0) & (neg > 0), F.round(area, 6)).alias("auc"))


def bin_of(score: Column, bins: int = 10) -> Column:
    """Equal bins of [0, 1], the last closed."""
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    return scored.groupBy(bin_of(F.col("score"), bins).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("label"), 6).alias("positive_rate"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    each = scored.groupBy(bin_of(F.col("score"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("label").alias("p"), F.sum(F.pow(F.col("score") - F.col("label"), 2.0)).alias("b"))
    return each.agg(F.sum("n").alias("n"), F.round(F.sum(F.abs(F.col("s") - F.col("p"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("b") / F.sum("n"), 6).alias("brier"))


def bin_calibrated(fit: DataFrame, apply: DataFrame, bins: int = 10) -> DataFrame:
    """Replace scores by the positive rate of their bin in ``fit``; an empty bin gives the overall rate."""
    rates = fit.groupBy(bin_of(F.col("score"), bins).alias("bin")).agg(F.avg("label").alias("rate"))
    overall = fit.agg(F.avg("label").alias("overall")).first()["overall"]
    return apply.withColumn("bin", bin_of(F.col("score"), bins)).join(F.broadcast(rates), "bin", "left").withColumn("calibrated", F.coalesce("rate", F.lit(overall))).drop("rate")


def head_entities(pairs: DataFrame, entity: str, quantile: float = 0.8) -> DataFrame:
    """Entities whose count reaches a quantile of all counts."""
    counts = pairs.groupBy(entity).agg(F.count("*").alias("n"))
    cut = counts.agg(F.percentile("n", F.lit(quantile)).alias("cut"))
    return counts.join(F.broadcast(cut), F.col("n") >= F.col("cut")).select(entity, "n")


def ideal_gain(n: Column) -> Column:
    """Discounted gain of n hits in the first n places."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))).otherwise(0.0)


def report_by_group(ranked: DataFrame, truth: DataFrame, k: int, by: str = "entity_type") -> DataFrame:
    """Per group: users with truth, those covered by candidates, hits, recall, precision and NDCG at k.

    ``ranked``: (by, user_id, item_id, rank); ``truth``: (by, user_id, item_id), distinct.
    """
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(truth, [by, "user_id", "item_id"]).groupBy(by, "user_id").agg(F.count("*").alias("h"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    covered = top.select(by, "user_id").distinct().withColumn("covered", F.lit(1))
    users = truth.groupBy(by, "user_id").agg(F.count("*").alias("n")).join(hits, [by, "user_id"], "left").join(covered, [by, "user_id"], "left")
    h, dcg = F.coalesce("h", F.lit(0)), F.coalesce("dcg", F.lit(0.0))
    return users.groupBy(by).agg(
        F.count("*").alias("users"), F.count("covered").alias("covered"), F.sum(h).alias("hits"), F.round(F.avg(h / F.col("n")), 6).alias("recall"), F.round(F.avg(h / F.lit(k)), 6).alias("precision"),
        F.round(F.avg(dcg / ideal_gain(F.least(F.col("n"), F.lit(k)))), 6).alias("ndcg"),
    )


def hit_counters(candidates: DataFrame, truth: DataFrame, by: str = "entity_type") -> DataFrame:
    """Per group: pairs of truth and those among candidates, users and those with a hit."""
    found = truth.join(candidates.select(by, "user_id", "item_id").distinct().withColumn("hit", F.lit(1)), [by, "user_id", "item_id"], "left")
    users = found.groupBy(by, "user_id").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    return users.groupBy(by).agg(F.sum("h").alias("hits"), F.sum("n").alias("total"), F.sum((F.col("h") > 0).cast("long")).alias("users_hit"), F.count("*").alias("users"))


def macro_recall(counters: DataFrame, by: str = "entity_type") -> DataFrame:
    """Mean of the groups' recalls, and the recall of all pairs together."""
    return counters.agg(F.round(F.avg(F.try_divide("hits", "total")), 6).alias("macro"), F.round(F.try_divide(F.sum("hits"), F.sum("total")), 6).alias("pooled"))


def reciprocal_rank(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean over users with truth of 1 / the rank of their first hit, 0 without one."""
    first = ranked.join(truth.distinct(), ["user_id", "item_id"]).groupBy("user_id").agg(F.min("rank").alias("rank"))
    users = truth.select("user_id").distinct().join(first, "user_id", "left")
    return users.agg(F.count("*").alias("users"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def simulation_quality(scored: DataFrame, truth: DataFrame, validation: DataFrame, head: DataFrame, by: str, k: int, missing: float) -> DataFrame:
    """Per entity_type: precision, recall and share of head entities in the first k of each target that has
    truth; AUC, Brier score and calibration error of all scored pairs, plain and calibrated on validation.

    ``scored``: (user_id, item_id, entity_type, probability), a null probability counts as ``missing``;
    ``by``: the target's side; ``head``: ids of the other side.
    """
    other = "item_id" if by == "user_id" else "user_id"
    pair, t = ["user_id", "item_id"], "entity_type"
    flag = lambda df, name: df.select(*pair).distinct().withColumn(name, F.lit(1))
    p = F.least(F.greatest(F.coalesce("probability", F.lit(missing)), F.lit(0.0)), F.lit(1.0))
    rows = scored.select(*pair, t, p.alias("score")).join(flag(truth, "_t"), pair, "left").join(flag(validation, "_v"), pair, "left")
    rows = rows.select(*pair, t, "score", F.coalesce("_t", F.lit(0)).alias("label"), F.coalesce("_v", F.lit(0)).alias("val"))
    place = F.row_number().over(Window.partitionBy(t, by).orderBy(F.col("score").desc(), other))
    top = rows.withColumn("r", place).where(F.col("r") <= k).join(head.select(other).distinct().withColumn("_h", F.lit(1)), other, "left")
    each = top.groupBy(t, by).agg(F.count("*").alias("n"), F.sum("label").alias("h"), F.count("_h").alias("heads")).join(truth.select(*pair).distinct().groupBy(by).agg(F.count("*").alias("g")), by)
    ranking = each.groupBy(t).agg(F.count("*").alias("targets"), F.round(F.avg(F.col("h") / F.col("n")), 6).alias("precision"), F.round(F.avg(F.col("h") / F.col("g")), 6).alias("recall"), F.round(F.avg(F.col("heads") / F.col("n")), 6).alias("head"))
    rates = rows.groupBy(t, bin_of(F.col("score")).alias("bin")).agg(F.avg("val").alias("rate"))
    calibrated = rows.withColumn("bin", bin_of(F.col("score"))).join(F.broadcast(rates), [t, "bin"])  # ten rows an entity type

    def errors(of: DataFrame, score: str, prefix: str) -> DataFrame:
        b = of.groupBy(t, bin_of(F.col(score)).alias("b")).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum("label").alias("p"), F.sum(F.pow(F.col(score) - F.col("label"), 2.0)).alias("q"))
        return b.groupBy(t).agg(F.round(F.sum("q") / F.sum("n"), 6).alias(f"{prefix}brier"), F.round(F.sum(F.abs(F.col("s") - F.col("p"))) / F.sum("n"), 6).alias(f"{prefix}ece"))

    counts = rows.groupBy(t).agg(F.count("*").alias("scored_pairs"), F.sum("label").alias("positive_pairs"))
    found = counts.join(ranking, t, "left").join(auc(rows, t).select(t, "auc"), t)
    return found.join(errors(calibrated, "score", ""), t).join(errors(calibrated, "rate", "cal_"), t)


def blend_scan(rows: DataFrame, weights: list[float], k: int, most: int = 50, by: str = "entity_type") -> DataFrame:
    """(by, weight, hits, truth) of scores weight * a + (1 - weight) * b, all weights in one pass.

    ``rows``: (user_id, item_id, by, a, b, label); candidates are what either score has among a user's first ``most`` of a
    group, and each is scored with every weight.  Hits are positives among a user's first ``k``, ties to the smaller item.
    """
    user = Window.partitionBy(by, "user_id")
    place = lambda c: F.row_number().over(user.orderBy(F.col(c).desc(), "item_id"))
    some = rows.withColumn("_a", place("a")).withColumn("_b", place("b")).where((F.col("_a") <= most) | (F.col("_b") <= most))
    each = some.withColumn("weight", F.explode(F.array(*map(F.lit, weights)))).withColumn("_s", F.round(F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b"), 9))
    ranked = each.withColumn("_r", F.row_number().over(Window.partitionBy(by, "user_id", "weight").orderBy(F.col("_s").desc(), "item_id")))
    hits = ranked.where(F.col("_r") <= k).groupBy(by, "weight").agg(F.sum("label").cast("long").alias("hits"))
    return hits.join(rows.groupBy(by).agg(F.sum("label").cast("long").alias("truth")), by)


def blend_choices(scan: DataFrame, thresholds: dict[str, float], by: str = "entity_type") -> DataFrame:
    """One row a choice of weights: a weight and a recall by group, ``overall``, margin, total, and whether it is chosen.

    ``scan`` as of ``blend_scan``; thresholds are by group, and for ``overall`` where it counts.  Chosen is the choice
    whose least margin over the thresholds is greatest, then the one of greatest sum, then of least weights.  There are
    few groups and weights, and one row for each choice of them.
    """
    groups = sorted(g for g in thresholds if g != "overall")
    lists = scan.groupBy().agg(*[F.sort_array(F.collect_list(F.when(F.col(by) == g, F.struct("weight", "hits", "truth")))).alias(f"_{g}") for g in groups])
    for g in groups:
        lists = lists.withColumn(f"_{g}", F.explode(f"_{g}"))
    recall = {g: F.col(f"_{g}.hits") / F.nullif(F.col(f"_{g}.truth"), F.lit(0)) for g in groups}
    recall["overall"] = sum(F.col(f"_{g}.hits") for g in groups) / F.nullif(sum(F.col(f"_{g}.truth") for g in groups), F.lit(0))
    told = lists.select(*[F.col(f"_{g}.weight").alias(f"{g}_weight") for g in groups], *[F.round(recall[g], 9).alias(g) for g in recall])
    margins = told.withColumn("margin", F.least(*[F.round(F.col(g) - t, 9) for g, t in thresholds.items()], F.lit(1.0))).withColumn("total", F.round(sum(F.col(g) for g in thresholds), 9))
    best = Window.orderBy(F.col("margin").desc(), F.col("total").desc(), *[f"{g}_weight" for g in groups])
    return margins.withColumn("chosen", F.row_number().over(best) == 1)
