"""Inputs that the queries share, as DataFrames and as SQL, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.functions.vectors import as_doubles
from frostline.operators.ids import hash_order
from frostline.operators.splits import entity_groups
from frostline.sources.storage import stored
from frostline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def h(x: str, seed: int | str) -> str:
    """SQL of ``hash_order``."""
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({x} AS VARCHAR)), 1, 8) AS BIGINT)"


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, ts, rating): customers and parts of order lines, a pair once."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.min("o_orderdate").alias("ts"), F.max("l_quantity").alias("rating"))


IX = "ix AS (SELECT o_custkey AS user_id, l_partkey AS item_id, min(o_orderdate) AS ts, max(l_quantity) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).select("user_id", "item_id")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs as scored candidates: entity_type, emb and llm from hashes of their ids."""
    key = F.concat_ws("-", "user_id", "item_id")
    return pairs(spark, sf_dir).select(
        "user_id", "item_id", F.when(hash_order(F.col("item_id"), "t") % 3 == 0, "warmup").otherwise("strict_cold").alias("entity_type"),
        ((hash_order(key, "e") % 1000000) / 1000000.0).alias("emb"), ((hash_order(key, "p") % 101) / 100.0).alias("llm"),
    )


_KEY = "user_id || '-' || item_id"
SP = f"{IX}, sp AS (SELECT user_id, item_id, CASE WHEN {h('item_id', 't')} % 3 = 0 THEN 'warmup' ELSE 'strict_cold' END AS entity_type, ({h(_KEY, 'e')} % 1000000) / 1000000.0::DOUBLE AS emb, ({h(_KEY, 'p')} % 101) / 100.0::DOUBLE AS llm FROM ix)"


def item_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_groups(pairs(spark, sf_dir), "item_id", k0=30)


def groups_sql(entity: str, k0: int, name: str = "grps", source: str = "ix") -> str:
    """SQL of ``entity_groups``."""
    return f"""{name}_d AS (SELECT {entity}, count(*) AS degree FROM {source} GROUP BY 1),
{name}_r AS (SELECT *, row_number() OVER (ORDER BY {h(entity, 42)}, {entity}) AS r, count(*) OVER () AS n FROM {name}_d),
{name}_t AS (SELECT *, CAST(floor(0.8 * n) AS BIGINT) AS nw, CAST(floor(0.1 * n) AS BIGINT) AS nc FROM {name}_r),
{name}_e AS (SELECT {entity}, row_number() OVER (ORDER BY r) AS e FROM {name}_t WHERE r > nw AND degree >= {k0} + 1),
{name} AS (SELECT {entity}, degree, CASE WHEN r <= nw THEN 'warm' WHEN e IS NOT NULL AND e <= n - nw - nc THEN 'warmup' ELSE 'strict_cold' END AS grp FROM {name}_t LEFT JOIN {name}_e USING ({entity}))"""


GROUPS = f"{IX}, {groups_sql('item_id', 30)}"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", as_doubles("embedding").alias("v"))


def item_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """(id, v) of the items (of some pairs, by default all) that have a vector."""
    items = (pairs(spark, sf_dir) if rows is None else rows).select("item_id").distinct()
    return vectors(spark, sf_dir).join(items, F.col("vec_id") == F.col("item_id"), "left_semi").select(F.col("vec_id").alias("id"), "v")


def user_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """(id, v): a user's vector is that of (7 * user + 3) modulo the number of vectors."""
    v = vectors(spark, sf_dir)
    n = v.count()
    users = (pairs(spark, sf_dir) if rows is None else rows).select("user_id").distinct().withColumn("vec_id", (F.col("user_id") * 7 + 3) % n)
    return users.join(v, "vec_id").select(F.col("user_id").alias("id"), "v")


VECTORS = "vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), iv AS (SELECT vec_id AS id, v FROM vecs WHERE vec_id IN (SELECT item_id FROM ix)), uv AS (SELECT user_id AS id, v FROM (SELECT DISTINCT user_id FROM ix) JOIN vecs ON vec_id = (user_id * 7 + 3) % (SELECT count(*) FROM embeddings))"


def part_terms(spark, d):
    """(id, term, weight): counts of the words of a part's name and type."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").cast("double").alias("weight"))


def grouped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item_id, grp): all pairs with their item's group, stored."""
    p = stored(pairs(spark, sf_dir))
    return stored(p.join(entity_groups(p, "item_id", k0=30).select("item_id", "grp"), "item_id").select("user_id", "item_id", "grp"))


def cold_setting(spark: SparkSession, sf_dir: str):
    """(cold items' vectors, users' vectors, training pairs): training is the pairs of warm items."""
    rows = grouped_pairs(spark, sf_dir)
    cold, train = cold_items(spark, sf_dir, rows)
    return cold, stored(user_vectors(spark, sf_dir, rows)), train


def cold_items(spark: SparkSession, sf_dir: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cold items' vectors, training pairs) of ``grouped_pairs``, where users' vectors aren't asked for."""
    return stored(item_vectors(spark, sf_dir, rows.where("grp <> 'warm'"))), rows.where("grp = 'warm'").select("user_id", "item_id")


def cold_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cold items' vectors, users' vectors) of ``cold_setting``, where training pairs aren't asked for: no pair gets its group."""
    p = stored(pairs(spark, sf_dir))
    cold = entity_groups(p, "item_id", k0=30).where("grp <> 'warm'")
    return stored(item_vectors(spark, sf_dir, cold)), stored(user_vectors(spark, sf_dir, p))


COLD = f"{GROUPS}, {VECTORS}, cold AS (SELECT iv.* FROM iv JOIN grps ON id = item_id WHERE grp <> 'warm'), train AS (SELECT user_id, item_id FROM ix JOIN grps USING (item_id) WHERE grp = 'warm')"
