"""Filters over interactions: thresholds, windows, cores and visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.sources.storage import discard, stored


def iterative_core(pairs: DataFrame, min_user: int, min_item: int) -> DataFrame:
    """Drop rare users, then rare items, until nothing changes; a minimum of 1 leaves its side alone.

    Each round's table is stored, counted from its files, and replaces the last one.
    """
    now = stored(pairs)
    n = now.count()
    while True:
        last = now
        for column, least in (("user_id", min_user), ("item_id", min_item)):
            if least > 1:
                now = now.join(now.groupBy(column).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(column), column, "left_semi")
        now = stored(now.select(*pairs.columns))
        discard(last)
        left = now.count()
        if left == n:
            return now
        n = left


def visible(rows: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` occurs in training."""
    return rows.join(train.select(column).distinct(), column, "left_semi").select(*rows.columns)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("true", "1", "yes")


def epoch_time(x: Column) -> Column:
    """Epoch numbers above 1e10 are milliseconds, others seconds."""
    return F.when(x > 1e10, F.timestamp_millis(x.cast("long"))).otherwise(F.timestamp_seconds(x.cast("long")))


def first_key(*names: str) -> Column:
    """The first of some columns that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


def contained_in_both(rows: DataFrame, a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` occurs in both tables."""
    return rows.join(a.select(column).intersect(b.select(column)), column, "left_semi").select(*rows.columns)


def in_range(rows: DataFrame, **sizes: int) -> DataFrame:
    """Rows whose ids, by column, lie in 0..size-1."""
    for column, n in sizes.items():
        rows = rows.where((F.col(column) >= 0) & (F.col(column) < n))
    return rows


#: Names under which tables give the columns of candidates.
NAMES = {
    "user_id": ("user_id", "user", "uid"),
    "item_id": ("item_id", "item", "iid"),
    "entity_type": ("entity_type", "split"),
    "probability": ("probability", "prob", "score"),
    "candidate_score": ("candidate_score", "embedding_score"),
    "title": ("title", "name", "book_title", "p_name"),
}


def found_name(rows: DataFrame, column: str, names: tuple[str, ...] | None = None) -> str | None:
    """The first of a column's names that a table has, whatever its letters' case."""
    have = {c.lower(): c for c in rows.columns}
    return next((have[n] for n in names or NAMES[column] if n in have), None)


def with_defaults(rows: DataFrame) -> DataFrame:
    """(user_id, item_id, entity_type, probability, candidate_score) under whatever names they come.

    No entity type is an empty one, no or a null probability is 1, no candidate score is the probability.
    """
    at = {c: F.col(f"`{n}`") if (n := found_name(rows, c)) else None for c in NAMES}
    if at["user_id"] is None or at["item_id"] is None:
        raise ValueError(f"no user or item among {rows.columns}")
    p = F.coalesce(at["probability"].cast("double"), F.lit(1.0)) if at["probability"] is not None else F.lit(1.0)
    kind = F.coalesce(at["entity_type"], F.lit("")) if at["entity_type"] is not None else F.lit("")
    score = at["candidate_score"].cast("double") if at["candidate_score"] is not None else p
    return rows.select(at["user_id"].cast("long").alias("user_id"), at["item_id"].cast("long").alias("item_id"), kind.alias("entity_type"), p.alias("probability"), score.alias("candidate_score"))


def pair_weights(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Pairs with their weight ``w``; without one, or one that isn't above 0, they weigh 1."""
    w = weights.groupBy("user_id", "item_id").agg(F.sum("w").alias("w"))
    return pairs.join(w, ["user_id", "item_id"], "left").withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
