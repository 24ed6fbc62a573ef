"""Cold-start splits: entity groups, warm rows, support, repair of visibility, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frostline.operators.ids import HashOrder, hash_order, numbered
from frostline.sources.storage import discard, stored


def entity_groups(pairs: DataFrame, entity: str, k0: int = 5, warm: float = 0.8, cold: float = 0.1, seed: int = 42) -> DataFrame:
    """(entity, degree, grp): the first floor(warm * n) by hash are warm; of the rest, those with more than
    k0 interactions, up to n - floor(warm n) - floor(cold n), are warmup; the others are strict_cold."""
    if k0 <= 1 or not 0 < warm + cold < 1:
        raise ValueError("k0 > 1, and warm and cold leave room for warmup")
    degrees = stored(pairs.groupBy(entity).agg(F.count("*").alias("degree")))
    order = hash_order(F.col(entity), seed)
    every = HashOrder(degrees, order, entity)
    n_warm = int(warm * every.n)
    (is_warm,) = every.first(n_warm)
    rest = ~is_warm & (F.col("degree") >= k0 + 1)
    (chosen,) = HashOrder(degrees.where(rest), order, entity).first(every.n - n_warm - int(cold * every.n))
    return degrees.select(entity, "degree", F.when(is_warm, "warm").when(rest & chosen, "warmup").otherwise("strict_cold").alias("grp"))


def warm_rows(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Rows with ``part``: by hash, a tenth val, a tenth test, the rest train."""
    pairs = stored(pairs)
    ranked = HashOrder(pairs, hash_order(F.concat_ws("-", "user_id", "item_id"), seed), "user_id", "item_id")
    val, test = ranked.first(ranked.n // 10, 2 * (ranked.n // 10))
    return pairs.select(*pairs.columns, F.when(val, "val").when(test, "test").otherwise("train").alias("part"))


def repair_visibility(parts: DataFrame) -> DataFrame:
    """Move rows of val, then test, whose user, then item, isn't in the train of that moment to train."""
    now = parts
    for part in ("val", "test"):
        for column in ("user_id", "item_id"):
            seen = now.where("part = 'train'").select(column).distinct().withColumn("_seen", F.lit(True))
            moved = F.when((F.col("part") == part) & F.col("_seen").isNull(), "train").otherwise(F.col("part"))
            last, now = now, stored(now.join(seen, column, "left").withColumn("part", moved).select(*parts.columns))
            if last is not parts:
                discard(last)
    return now


def warmup_support(rows: DataFrame, entity: str, k0: int = 5, seed: int = 42) -> DataFrame:
    """Rows of entities with more than k0 rows, with ``part``: 1..k0-1 support rows by hash, the rest half
    val and half test; entities left without either go."""
    other = "item_id" if entity == "user_id" else "user_id"
    order = Window.partitionBy(entity).orderBy(hash_order(F.concat_ws("-", "user_id", "item_id"), seed), other)
    sized = rows.withColumn("n", F.count("*").over(Window.partitionBy(entity))).where(F.col("n") >= k0 + 1)
    support = 1 + hash_order(F.col(entity), f"{seed}s") % (k0 - 1)
    cut = sized.withColumn("r", F.row_number().over(order)).withColumn("s", support).withColumn("v", F.floor((F.col("n") - F.col("s")) / 2))
    part = F.when(F.col("r") <= F.col("s"), "support").when(F.col("r") <= F.col("s") + F.col("v"), "val").otherwise("test")
    return cut.where("v >= 1 and n - s - v >= 1").select(*rows.columns, part.alias("part"))


def strict_split(rows: DataFrame, entity: str, seed: int = 42) -> DataFrame:
    """Rows with ``part``: whole entities by hash, half val (one at least, not all) and the rest test; a
    single entity goes to test."""
    rows = stored(rows)
    order = hash_order(F.col(entity), f"{seed}c")
    ranked = HashOrder(rows.select(entity).distinct(), order, entity)
    (val,) = ranked.first(0 if ranked.n < 2 else min(max(ranked.n // 2, 1), ranked.n - 1))
    return rows.select("*", F.when(val, "val").otherwise("test").alias("part"))


def split_tables(pairs: DataFrame, entity: str = "item_id", k0: int = 5, seed: int = 42) -> DataFrame:
    """(split, user_id, item_id): warm, warm-up and strict-cold parts over a common training set."""
    other = "user_id" if entity == "item_id" else "item_id"
    pairs = stored(pairs.select("user_id", "item_id"))
    grouped = stored(pairs.join(entity_groups(pairs, entity, k0, seed=seed).select(entity, "grp"), entity).select("user_id", "item_id", "grp"))
    of = lambda g: grouped.where(F.col("grp") == g).select("user_id", "item_id")
    warm = repair_visibility(warm_rows(of("warm"), seed))
    support = stored(warmup_support(of("warmup"), entity, k0, seed))
    base = warm.where("part = 'train'").select("user_id", "item_id")
    train = stored(base.union(support.where("part = 'support'").select("user_id", "item_id")).distinct())
    seen = train.select(other).distinct()
    strict = strict_split(of("strict_cold").join(seen, other, "left_semi").select("user_id", "item_id"), entity, seed)
    named = lambda df, s: df.select(F.lit(s).alias("split"), "user_id", "item_id")
    out = [named(train, "warm_train"), named(base, "warm_train_original"), named(support.where("part = 'support'"), "warmup_support")]
    for part in ("val", "test"):
        three = [named(warm.where(F.col("part") == part), f"warm_{part}"), named(support.where(F.col("part") == part).join(seen, other, "left_semi"), f"warmup_{part}"), named(strict.where(F.col("part") == part), f"cold_{part}")]
        out += three
        out += [named(x, f"overall_{part}") for x in three]
    rows = out[0]
    for x in out[1:]:
        rows = rows.union(x)
    return rows


def split_outputs(splits: DataFrame, cold: str) -> DataFrame:
    """``split_tables`` under all their names: the cold object is named, training sets are embedding sets as well,
    strict cold parts are also one set, and have their older names."""
    plain = splits.withColumn("split", F.replace("split", F.lit("cold_"), F.lit(f"cold_{cold}_")))
    train = splits.where(F.col("split").startswith("warm_train")).withColumn("split", F.replace("split", F.lit("train"), F.lit("emb")))
    strict = splits.where(F.col("split").startswith("cold_"))
    older = strict.withColumn("split", F.concat(F.lit(f"strict_cold_{cold}_"), F.expr("substr(split, 6)")))
    return plain.union(train).union(strict.withColumn("split", F.lit(f"cold_{cold}"))).union(older)


def temporal_parts(rows: DataFrame, opposite: str, time: str = "ts", train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Rows with ``part`` by relative time; the earliest later row of each opposite entity that training
    hasn't seen is moved to train.  Rows need a column ``row_idx`` to settle equal times."""
    n = rows.count()
    a = min(max(int(n * train), 1), max(n - 2, 1))
    b = min(max(int(n * (train + val)), a + 1), max(n - 1, a + 1))
    ranked = stored(numbered(rows, time, "row_idx", name="r").withColumn("part", F.when(F.col("r") <= a, "train").when(F.col("r") <= b, "val").otherwise("test")))
    seen = ranked.where("part = 'train'").select(opposite).distinct()
    late = ranked.where("part <> 'train'").join(seen, opposite, "left_anti")
    anchors = late.groupBy(opposite).agg(F.min("r").alias("r")).select("r", F.lit(True).alias("_anchor"))
    return ranked.join(anchors, "r", "left").withColumn("part", F.when(F.col("_anchor"), "train").otherwise(F.col("part"))).drop("_anchor", "r")


def temporal_groups(parts: DataFrame, entity: str, k0: int = 5) -> DataFrame:
    """(entity, n_train, grp) of entities that occur in val or test: none in training strict_cold, fewer
    than k0 warmup, else warm."""
    evaluated = parts.where("part <> 'train'").select(entity).distinct()
    counts = parts.where("part = 'train'").groupBy(entity).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return evaluated.join(counts, entity, "left").select(entity, n.alias("n_train"), F.when(n == 0, "strict_cold").when(n < k0, "warmup").otherwise("warm").alias("grp"))


def evaluation_sample(groups: DataFrame, entity: str, size: int, seed: int = 42) -> DataFrame:
    """Up to ``size`` entities: quotas of 40 % strict and 30 % warm-up, filled from warm, then any."""
    strict, warmup = -(-4 * size // 10), -(-3 * size // 10)
    ranked = numbered(groups, "grp", hash_order(F.col(entity), seed), entity, name="g")
    firsts = ranked.groupBy("grp").agg(F.min("g").alias("g0"))
    within = ranked.join(F.broadcast(firsts), "grp").withColumn("k", F.col("g") - F.col("g0") + 1)  # three groups
    first = (F.col("grp") == "strict_cold") & (F.col("k") <= strict) | (F.col("grp") == "warmup") & (F.col("k") <= warmup)
    level = F.when(first, 0).when(F.col("grp") == "warm", 1).otherwise(2)
    filled = numbered(within.withColumn("level", level), "level", "grp", "k", entity, name="at")
    return filled.where(F.col("at") <= size).select(entity, "grp")


def temporal_tables(parts: DataFrame, opposite: str, entity: str, k0: int = 5, cold: str = "item") -> DataFrame:
    """(split, user_id, item_id) of rows with ``part`` by time: warm, warm-up and strict-cold parts, as ``split_tables`` has them.

    Later rows count only for opposite entities that training has seen.  An entity is strict cold without training
    rows, warm-up with fewer than k0, else warm; training keeps the rows of warm and warm-up ones.
    """
    rows = stored(parts.select("user_id", "item_id", "part").distinct())
    train = rows.where("part = 'train'")
    later = rows.where("part <> 'train'").join(train.select(opposite).distinct(), opposite, "left_semi")
    groups = stored(temporal_groups(train.select(*rows.columns).union(later.select(*rows.columns)), entity, k0).select(entity, "grp"))
    placed = stored(train.select(*rows.columns).union(later.select(*rows.columns)).join(groups, entity))
    of = lambda split, *where: placed.where(" and ".join(where)).select(F.lit(split).alias("split"), "user_id", "item_id")
    warm, warmup, strict = "grp = 'warm'", "grp = 'warmup'", "grp = 'strict_cold'"
    out = [of("warm_train_original", "part = 'train'", warm), of("warmup_support", "part = 'train'", warmup), of("train", "part = 'train'"), of(f"cold_{cold}", "part <> 'train'", strict)]
    for part in ("val", "test"):
        on = f"part = '{part}'"
        out += [of(f"warm_{part}", on, warm), of(f"warmup_{part}", on, warmup), of(f"cold_{cold}_{part}", on, strict), of(f"overall_{part}", on)]
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every.distinct()


def sampled_temporal_tables(rows: DataFrame, size: int, k0: int = 5, train: float = 0.6, val: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(splits, user ids, item ids) of rows (user_id, item_id, ts, row_idx) after a sample of at most ``size`` evaluated items.

    Rows are split by time; of later rows those of the sampled items stay (all, where there are no more than ``size``);
    what is left is split by time again, and ids are numbered from 0 without gaps: (user_id, user_no), (item_id, item_no).
    """
    parts = stored(temporal_parts(rows, "user_id", train=train, val=val).select("user_id", "item_id", "ts", "row_idx", "part"))
    groups = stored(temporal_groups(parts, "item_id", k0).select("item_id", "grp"))
    kept = parts
    if groups.count() > size:
        some = evaluation_sample(groups, "item_id", size, seed).select("item_id")
        kept = parts.where("part = 'train'").union(parts.where("part <> 'train'").join(some, "item_id", "left_semi").select(*parts.columns))
        kept = stored(temporal_parts(kept.drop("part"), "user_id", train=train, val=val))
    ids = []
    for c, no in (("user_id", "user_no"), ("item_id", "item_no")):
        ids.append(stored(numbered(kept.select(c).distinct(), c, name=no).withColumn(no, F.col(no) - 1)))
    splits = temporal_tables(kept, "user_id", "item_id", k0)
    return splits.join(ids[0], "user_id").join(ids[1], "item_id").select("split", F.col("user_no").alias("user_id"), F.col("item_no").alias("item_id")), *ids
