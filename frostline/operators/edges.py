"""Selectors: scored candidates become weighted pseudo-interactions (user_id, item_id, entity_type, probability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_minmax(x: Column, window, flat: float | str = 0.5, rank: Column | None = None) -> Column:
    """Scale to [0, 1] in a group.  A flat group gives ``flat``, or by rank: 1 - (rank-1)/(n-1), alone 1."""
    low, high = F.min(x).over(window), F.max(x).over(window)
    n = F.count("*").over(window)
    same = F.when(n <= 1, 1.0).otherwise(1 - (rank - 1) / (n - 1)) if flat == "rank" else F.lit(flat)
    return F.when(high > low, (x - low) / (high - low)).otherwise(same)


def rank_linear(r: Column, n: Column, high: float = 1.0, low: float = 0.6) -> Column:
    """From ``high`` at rank 1 to ``low`` at the last."""
    return F.when(n <= 1, high).otherwise(high - (high - low) * (r - 1) / (n - 1))


def kept_above(rows: DataFrame, threshold: float, topn: int, least: int = 0, one_more: bool = False, mode: str = "raw") -> DataFrame:
    """Per (item, entity_type), by falling score: rows at the threshold, some more up to a minimum, a cap.

    With ``one_more``, a minimum adds one row even where it is reached already.  Probabilities are raw,
    constant 1, or linear by rank.
    """
    w = Window.partitionBy("item_id", "entity_type")
    order = w.orderBy(F.col("score").desc(), F.col("user_id"))
    above = F.sum(F.when(F.col("score") >= threshold, 1).otherwise(0)).over(w)
    keep = F.greatest(above + (1 if one_more and least else 0), F.lit(least)) if least else above
    ranked = rows.withColumn("r", F.row_number().over(order)).withColumn("keep", F.least(keep, F.lit(topn)))
    chosen = ranked.where(F.col("r") <= F.col("keep"))
    n = F.count("*").over(w)
    p = {"raw": F.col("score"), "constant": F.lit(1.0), "rank": rank_linear(F.col("r"), n)}[mode]
    return chosen.select("user_id", "item_id", "entity_type", p.alias("probability"))


def blended(rows: DataFrame, by: str, weight: float, k: int | dict[str, int], default_k: int = 20) -> DataFrame:
    """Mix group-scaled ``llm`` and ``emb`` scores, keep k of each group, weigh linearly by rank (1 to 0.6)."""
    w = Window.partitionBy(by, "entity_type")
    mixed = rows.withColumn("blend", F.round(weight * group_minmax(F.col("llm"), w) + (1 - weight) * group_minmax(F.col("emb"), w), 9))
    other = "user_id" if by == "item_id" else "item_id"
    order = w.orderBy(F.col("blend").desc(), F.col("llm").desc(), F.col("emb").desc(), F.col(other))
    limit = F.lit(k) if isinstance(k, int) else budget(k, default_k)
    top = mixed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    return top.select("user_id", "item_id", "entity_type", "blend", F.col("r").alias("rank"), rank_linear(F.col("r"), F.count("*").over(w)).alias("probability"))


def budget(k: dict[str, int], default: int) -> Column:
    """A number by entity_type."""
    out = F.lit(default)
    for name, n in k.items():
        out = F.when(F.col("entity_type") == name, n).otherwise(out)
    return out


def hybrid(rows: DataFrame, alpha: float, least: float, k: int) -> DataFrame:
    """alpha * scaled content + (1 - alpha) * llm, at least ``least``, k per user by (hybrid, content, llm)."""
    user = Window.partitionBy("user_id")
    placed = rows.withColumn("cr", F.row_number().over(user.orderBy(F.col("emb").desc(), F.col("item_id"))))
    content = group_minmax(F.col("emb"), user, "rank", F.col("cr"))
    scored = placed.withColumn("content", content).withColumn("hybrid", F.round(F.least(F.greatest(alpha * F.col("content") + (1 - alpha) * F.col("llm"), F.lit(0.0)), F.lit(1.0)), 9)).where(F.col("hybrid") >= least)
    order = user.orderBy(F.col("hybrid").desc(), F.col("content").desc(), F.col("llm").desc(), F.col("item_id"))
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("user_id", "item_id", "entity_type", F.col("hybrid").alias("probability"))


def rank_weight(r: Column, n: int, mode: str, floor: float = 0.05, gamma: float = 0.9) -> Column:
    """Weights by rank: linear, inverse or exponential, at least ``floor``."""
    w = {"linear": 1 - (r - 1) / F.lit(n), "inverse": 1 / r.cast("double"), "exponential": F.pow(F.lit(gamma), (r - 1).cast("double"))}[mode]
    return F.least(F.greatest(w.cast("double"), F.lit(floor)), F.lit(1.0))


def content_ranked(rows: DataFrame) -> DataFrame:
    """Add content_rank within (entity_type, user)."""
    w = Window.partitionBy("entity_type", "user_id").orderBy(F.col("emb").desc(), F.col("item_id"))
    return rows.withColumn("content_rank", F.row_number().over(w))


def high_first(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """Rows whose llm score reaches the threshold in content order, then the others; k per user."""
    w = Window.partitionBy("entity_type", "user_id").orderBy((F.col("llm") >= threshold).cast("int").desc(), F.col("content_rank"))
    return content_ranked(rows).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("user_id", "item_id", "entity_type", F.col("r").alias("rank"))


def tail_swap(rows: DataFrame, threshold: float, protect: int, k: int) -> DataFrame:
    """The first k by content; beyond ``protect`` a row below the threshold gives way to the next row after
    k that reaches it, one for one."""
    keys = ["entity_type", "user_id"]
    r = content_ranked(rows)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("content_rank")).alias("nth")
    weak = r.where((F.col("content_rank") > protect) & (F.col("content_rank") <= k) & (F.col("llm") < threshold)).select(*keys, F.col("content_rank").alias("slot"), nth)
    strong = r.where((F.col("content_rank") > k) & (F.col("llm") >= threshold)).select(*keys, F.col("item_id").alias("new_item"), nth)
    swaps = weak.join(strong, [*keys, "nth"]).select(*keys, F.col("slot").alias("content_rank"), "new_item")
    out = r.where(F.col("content_rank") <= k).join(swaps, [*keys, "content_rank"], "left")
    return out.select("user_id", F.coalesce("new_item", "item_id").alias("item_id"), "entity_type", F.col("content_rank").alias("rank"), F.col("new_item").isNotNull().alias("swapped"))


def quota(rows: DataFrame, popularity: DataFrame, penalty: float, threshold: float, topn: int, least: int, per_item: int) -> DataFrame:
    """Rank by score less a penalty for popularity; threshold, cap, fill up to a minimum; at most
    ``per_item`` rows of an item, by the global order."""
    p = rows.join(popularity, "item_id", "left").withColumn("rank_score", F.round(F.col("score") - penalty * F.coalesce("popularity", F.lit(0.0)), 9))
    w = Window.partitionBy("user_id", "entity_type")
    above = (F.col("score") >= threshold).cast("int")
    order = w.orderBy(above.desc(), F.col("rank_score").desc(), F.col("score").desc(), F.col("item_id"))
    keep = F.least(F.greatest(F.sum(above).over(w), F.lit(least)), F.lit(topn))
    chosen = p.withColumn("keep", keep).withColumn("r", F.row_number().over(order)).where("r <= keep")
    item = Window.partitionBy("item_id").orderBy(F.col("rank_score").desc(), F.col("score").desc(), F.col("user_id"), F.col("entity_type"))
    return chosen.withColumn("at", F.row_number().over(item)).where(F.col("at") <= per_item).select("user_id", "item_id", "entity_type", F.col("score").alias("probability"))


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], c: float, k: int) -> DataFrame:
    """Sum of weight / (c + rank) over lists of (user_id, item_id, rank); k per user, scaled (flat: 1)."""
    rows = None
    for df, weight in lists:
        part = df.select("user_id", "item_id", (F.lit(weight) / (c + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.union(part)
    summed = rows.groupBy("user_id", "item_id").agg(F.round(F.sum("s"), 9).alias("score"))
    w = Window.partitionBy("user_id")
    top = summed.withColumn("r", F.row_number().over(w.orderBy(F.col("score").desc(), F.col("item_id")))).where(F.col("r") <= k)
    return top.select("user_id", "item_id", F.col("r").alias("rank"), group_minmax(F.col("score"), w, 1.0).alias("probability"))


def core_tail(core: DataFrame, tail: DataFrame, n: int, k: int) -> DataFrame:
    """The first n of one list, then the other list, then the rest of the first; each item once; k per user."""
    rows = core.select("user_id", "item_id", F.when(F.col("rank") <= n, 0).otherwise(2).alias("o"), "rank").union(tail.select("user_id", "item_id", F.lit(1), "rank"))
    first = rows.groupBy("user_id", "item_id").agg(F.min(F.struct("o", "rank")).alias("p"))
    w = Window.partitionBy("user_id").orderBy("p.o", "p.rank", "item_id")
    return first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("user_id", "item_id", F.col("r").alias("rank"))


def merged(*tables: DataFrame) -> DataFrame:
    """The largest probability of each (user, item, entity_type); a null one counts as 1, all are clipped."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    p = F.least(F.greatest(F.coalesce("probability", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return rows.groupBy("user_id", "item_id", "entity_type").agg(F.max(p).alias("probability"))


def by_source(strict: DataFrame, warmup: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Strict rows of one table and warm-up rows of another, probabilities to the power gamma."""
    rows = strict.where("entity_type = 'strict_cold'").unionByName(warmup.where("entity_type = 'warmup'"))
    return rows.withColumn("probability", F.least(F.greatest(F.pow("probability", F.lit(gamma)), F.lit(0.0)), F.lit(1.0)))


def nine_features(rows: DataFrame, popularity: DataFrame, pool: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (user_id, item_id, entity_type, score, and what ``keep`` names) with nine features of a score's place in its user's list.

    Scaled score (by rank over ``pool`` where all are equal), rank share, 1 / rank, score over the best,
    z-score, gaps to the rows before, after and the best, and the item's popularity (``popularity``: item_id, pop).
    """
    s, w = F.col("score"), Window.partitionBy("entity_type", "user_id")
    o = w.orderBy(s.desc(), F.col("item_id"))
    low, high = F.min(s).over(w), F.max(s).over(w)
    span, sd = F.nullif(high - low, F.lit(0.0)), F.nullif(F.coalesce(F.stddev_samp(s).over(w), F.lit(0.0)), F.lit(0.0))
    within = lambda x, a, b: F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(a)), F.lit(b))
    # An item's popularity comes to its rows before they have features: nine numbers a row are made where lists lie and sent nowhere.
    most = popularity.agg(F.max("pop").alias("_most"))
    known = rows.join(popularity.select("item_id", "pop"), "item_id", "left").withColumn("r", F.row_number().over(o))
    popular = within(F.log1p(F.coalesce("pop", F.lit(0)).cast("double")) / F.log1p(F.col("_most").cast("double")), 0.0, 1.0)
    by_rank = 1 - (F.col("r") - 1) / F.lit(float(pool - 1))
    made = known.select(
        "user_id", "item_id", "entity_type", *keep, "pop", within(F.coalesce((s - low) / span, by_rank), 0.0, 1.0).alias("scaled"), (1 - by_rank).alias("rank_share"), (1 / F.col("r")).alias("inverse_rank"),
        F.coalesce(s / F.nullif(high, F.lit(0.0)), F.lit(0.0)).alias("to_best"), within((s - F.avg(s).over(w)) / sd, -10.0, 10.0).alias("z"), within((F.lag(s).over(o) - s) / span, 0.0, 10.0).alias("gap_before"),
        within((s - F.lead(s).over(o)) / span, 0.0, 10.0).alias("gap_after"), within((high - s) / span, 0.0, 10.0).alias("gap_best"),
    )
    return made.where("item_id is not null").join(F.broadcast(most), F.lit(True)).withColumn("popular", popular).drop("pop", "_most")


def first_of(rows: DataFrame, k: dict[str, int], default: int = 20) -> DataFrame:
    """Of ranked lists (user_id, item_id, entity_type, rank, ...) the first rows, as many as the entity type has."""
    return rows.where(F.col("rank") <= budget(k, default))


def probability_of_lists(rows: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(user_id, item_id, entity_type, rank, probability): scores scaled within a user's list (flat: 1), to the power gamma."""
    p = group_minmax(F.col("score"), Window.partitionBy("entity_type", "user_id"), 1.0)
    return rows.select("user_id", "item_id", "entity_type", "rank", F.pow(p, F.lit(gamma)).alias("probability"))


def source_mix(old: DataFrame, new: DataFrame, strict: str, warmup: str, k: dict[str, int], gamma: float = 1.0) -> DataFrame:
    """Strict rows of one list and warm-up rows of the same or the other, the first k of each, by their list's probabilities."""
    of = {"old": old, "new": new}
    rows = of[strict].where("entity_type = 'strict_cold'").unionByName(of[warmup].where("entity_type = 'warmup'"))
    return probability_of_lists(first_of(rows, k), gamma)


def core_tail_lists(old: DataFrame, new: DataFrame, core: dict[str, int], k: dict[str, int], old_only: tuple[str, ...] = (), gamma: float = 1.0) -> DataFrame:
    """Per list: the first rows of the old one, then the new one, then the rest of the old one, each item once, k in all.

    Entity types of ``old_only`` take nothing new.  Probabilities fall linearly with the place, 1 to 0.6, to the power gamma.
    """
    keys = ["entity_type", "user_id"]
    a = old.select(*keys, "item_id", F.when(F.col("rank") <= budget(core, 0), 0).otherwise(2).alias("o"), "rank")
    b = new.where(~F.col("entity_type").isin(*old_only)).select(*keys, "item_id", F.lit(1).alias("o"), "rank") if old_only else new.select(*keys, "item_id", F.lit(1).alias("o"), "rank")
    first = a.union(b).groupBy(*keys, "item_id").agg(F.min(F.struct("o", "rank")).alias("p"))
    w = Window.partitionBy(*keys)
    placed = first.withColumn("rank", F.row_number().over(w.orderBy("p.o", "p.rank", "item_id")))
    kept = first_of(placed, k)
    return kept.select("user_id", "item_id", "entity_type", "rank", F.pow(rank_linear(F.col("rank"), F.count("*").over(w)), F.lit(gamma)).alias("probability"))


def rrf_lists(old: DataFrame, new: DataFrame, k: dict[str, int], c: float = 60.0, weight: float = 1.0, old_only: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion within each list; entity types of ``old_only`` take nothing new."""
    keys = ["entity_type", "user_id"]
    fresh = new.where(~F.col("entity_type").isin(*old_only)) if old_only else new
    part = lambda df, x: df.select(*keys, "item_id", (F.lit(x) / (c + F.col("rank"))).alias("s"))
    summed = part(old, 1.0).union(part(fresh, weight)).groupBy(*keys, "item_id").agg(F.round(F.sum("s"), 9).alias("score"))
    placed = summed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "item_id")))
    return probability_of_lists(first_of(placed, k))


def fused_variants(old: DataFrame, new: DataFrame, variants: dict[str, tuple], k: dict[str, int], pool: int, c: float = 60.0) -> DataFrame:
    """(variant, user_id, item_id, entity_type, rank, probability): many ways to fuse two lists, ranked together.

    A variant is ("mix", strict list, warm-up list, gamma) as in ``source_mix``, ("tail", core, warm-up old only, gamma)
    as in ``core_tail_lists`` of the lists' first k, or ("rrf", whole pool, warm-up old only) as in ``rrf_lists``.  Each
    list's items come together once, in one array with their places in both lists (twice the longest list at most); every variant
    orders and cuts that array where it lies, so no variant's rows are sent anywhere.
    """
    by = ["entity_type", "user_id"]
    keys = [*by, "item_id"]
    limit, none, warmup = budget(k, 20), F.lit(None).cast("double"), F.col("entity_type") == "warmup"
    side = lambda df, x: df.where(F.col("rank") <= F.greatest(limit, F.lit(pool))).select(*keys, *[(F.col(n) if a == x else F.lit(None)).cast(t).alias(f"{n}_{a}") for a in ("old", "new") for n, t in (("rank", "int"), ("score", "double"))])
    places = [f"{n}_{a}" for a in ("old", "new") for n in ("rank", "score")]
    both = side(old, "old").union(side(new, "new")).repartition(*by).groupBy(*keys).agg(*[F.max(c).alias(c) for c in places])
    lists = both.groupBy(*by).agg(F.collect_list(F.struct("item_id", *places)).alias("x"))

    def placed(e: Column, how: str, *args) -> Column:
        ro, rn = e["rank_old"].cast("double"), e["rank_new"].cast("double")
        if how == "mix":
            pick = lambda of: F.when(warmup, e[f"{of}_{args[1]}"]).otherwise(F.when(F.col("entity_type") == "strict_cold", e[f"{of}_{args[0]}"]))
            first, second, score = F.when(pick("rank") <= limit, pick("rank").cast("double")), F.lit(0.0), pick("score")
        elif how == "tail":
            fresh = (rn <= limit) & ~(warmup & F.lit(args[1]))
            core = ro <= budget(args[0], 0)
            first = F.when(core & (ro <= limit), 0.0).when(fresh, 1.0).when(ro <= limit, 2.0)
            second, score = F.when(first == 1.0, rn).otherwise(ro), none
        else:
            upto = F.lit(pool) if args[0] else limit
            one, two = F.when(ro <= upto, 1 / (c + ro)), F.when((rn <= upto) & ~(warmup & F.lit(args[1])), 1 / (c + rn))
            score = F.when(one.isNotNull() | two.isNotNull(), F.round(F.coalesce(one, F.lit(0.0)) + F.coalesce(two, F.lit(0.0)), 9))
            first, second = -score, F.lit(0.0)
        return F.struct(first.alias("first"), second.alias("second"), e["item_id"].alias("item_id"), score.alias("score"))

    def shaped(name: str, how: str, *args) -> Column:
        rows = F.filter(F.transform("x", lambda e: placed(e, how, *args)), lambda e: e["first"].isNotNull())
        gamma = 1.0 if how == "rrf" else float(args[2])
        return F.struct(F.lit(name).alias("variant"), F.slice(F.sort_array(rows), F.lit(1), limit).alias("kept"), F.lit(gamma).alias("gamma"))

    each = lists.select(*by, F.explode(F.array(*[shaped(n, *v) for n, v in variants.items()])).alias("v")).select(*by, "v.*")
    scores = F.transform("kept", lambda e: e["score"])
    sized = each.withColumn("n", F.size("kept")).withColumn("low", F.array_min(scores)).withColumn("high", F.array_max(scores))
    kept = sized.select("variant", *by, "gamma", "n", "low", "high", F.posexplode("kept").alias("at", "e")).withColumn("rank", F.col("at") + 1)
    flat = F.when(F.col("high") > F.col("low"), (F.col("e.score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    scaled = F.when(F.col("e.score").isNull(), rank_linear(F.col("rank"), F.col("n"))).otherwise(flat)
    return kept.select("variant", "user_id", "e.item_id", "entity_type", "rank", F.pow(scaled, F.col("gamma")).alias("probability"))
