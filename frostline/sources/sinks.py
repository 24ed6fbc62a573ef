"""Writers: pairs, splits, JSON lines, shards with a manifest and their merge, score exports, report rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators.ids import numbered, running_total, segments
from frostline.operators.stats import shard_sizes
from frostline.sources.storage import move_or_delete, stored, write_text


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Distinct pairs as CSV with a header ``user,item``."""
    pairs.select(F.col("user_id").alias("user"), F.col("item_id").alias("item")).distinct().write.option("header", True).csv(path)


def write_splits(splits: DataFrame, path: str) -> None:
    """A folder of CSV files for each split of (split, user_id, item_id); the source stays as it is."""
    splits.select("split", F.col("user_id").alias("user"), F.col("item_id").alias("item")).write.partitionBy("split").option("header", True).csv(path)


def write_summary(splits: DataFrame, path: str, **facts) -> dict:
    """Numbers of users, items and records of each split of (split, user_id, item_id), and other facts, as a JSON file
    ``split_meta.json`` beside the splits; there are few splits."""
    counts = splits.groupBy("split").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.count("*").alias("records"))
    summary = facts | {"splits": {r["split"]: {c: r[c] for c in ("users", "items", "records")} for r in counts.orderBy("split").collect()}}
    write_text(splits.sparkSession, f"{path}/split_meta.json", json.dumps(summary, indent=2, ensure_ascii=False))
    return summary


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(split, users, items, records) of a folder's summary."""
    schema = "splits map<string, struct<users: long, items: long, records: long>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/split_meta.json")
    return rows.select(F.explode("splits").alias("split", "x")).select("split", "x.users", "x.items", "x.records")


def write_json_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Rows as JSON lines; the names of files and the lines in them follow an order of rows."""
    (rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows).write.json(path)


def write_shards(rows: DataFrame, path: str, weights: DataFrame) -> DataFrame:
    """Rows numbered by row_idx (from 0) in contiguous shards, a folder each; the manifest (shard, start, size).

    ``weights``: (shard, weight); sizes are shared by largest remainders.
    """
    manifest = stored(shard_sizes(rows.count(), weights))
    at = F.broadcast(manifest)  # one row a shard
    placed = rows.join(at, (F.col("row_idx") >= F.col("start")) & (F.col("row_idx") < F.col("start") + F.col("size")))
    placed.drop("start", "size").write.partitionBy("shard").parquet(path)
    return manifest


def merge_shards(spark: SparkSession, path: str, manifest: DataFrame, to: str) -> DataFrame:
    """All shards as one table at ``to``: written aside, counted, then renamed, so that no half table is ever seen.

    A shard whose rows aren't as many as the manifest says is an error.
    """
    rows = spark.read.parquet(path)
    counts = rows.groupBy("shard").agg(F.count("*").alias("n"))
    wrong = manifest.where("size > 0").join(counts, "shard", "full_outer").where("n is null or size is null or n <> size")
    if bad := wrong.limit(5).collect():
        raise ValueError(f"shards of another size than the manifest's: {bad}")
    rows.drop("shard").repartitionByRange("row_idx").sortWithinPartitions("row_idx").write.parquet(f"{to}.tmp")
    move_or_delete(spark, f"{to}.tmp", to)
    return spark.read.parquet(to)


def ragged(truth: DataFrame, user: str = "user_id", item: str = "item_id", size: int = 1_024) -> DataFrame:
    """(user, start, items): users' items in order, ``size`` a row, and where each row's start in all users' items one after another."""
    lists = stored(segments(truth, item, user, size=size))
    starts = running_total(lists.select(user, "segment", F.size("items").alias("n")), "n", user, "segment", name="start")
    return lists.join(starts.select(user, "segment", "start"), [user, "segment"]).select(user, "start", "items")


def exclude_coordinates(positives: DataFrame, truth: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """(row_idx, item): positives of the users that have a truth which aren't in it; rows are those users in order from 0."""
    rows = numbered(truth.select(user).distinct(), user, name="row_idx").withColumn("row_idx", F.col("row_idx") - 1)
    return positives.select(user, item).distinct().join(truth.select(user, item), [user, item], "left_anti").join(rows, user).select("row_idx", item)


def fixed(x: Column, digits: int) -> Column:
    """A number of no sign rounded half up to some digits, as text."""
    whole = F.floor(x * 10**digits + 0.5).cast("long")
    return F.concat((whole / F.lit(10**digits)).cast("long").cast("string"), F.lit("."), F.lpad((whole % 10**digits).cast("string"), digits, "0"))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def latex_row(*cells: Column) -> Column:
    return F.concat(F.concat_ws(" & ", *cells), F.lit(" \\\\"))
