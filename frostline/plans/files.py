"""Queries over readers and writers: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from frostline.operators import candidates as C
from frostline.operators import splits, stats
from frostline.operators.ids import numbered, segments
from frostline.plans.base import COLD, GROUPS, IX, cold_sides, grouped_pairs, interactions, pairs, query
from frostline.plans.data import _FT, _PR, _predictions, segments_sql
from frostline.plans.measures import _MET, _met
from frostline.sources import matrix_sink, sinks, tables
from frostline.sources.storage import new_path, stored
from frostline.sources.tables import table


@query(f"WITH {IX} SELECT user_id, item_id FROM ix")
def known_pairs(spark, d):
    """All pairs of every CSV of a folder, repeated ones once; a file that isn't there has none."""
    path, p = new_path(spark, "pairs"), pairs(spark, d)
    sinks.write_pairs(p.where("user_id % 2 = 0"), f"{path}/a.csv")
    sinks.write_pairs(p.where("user_id % 2 = 1 or item_id % 3 = 0"), f"{path}/b.csv")
    return tables.read_pairs(spark, f"{path}/*.csv").union(tables.read_pairs(spark, f"{path}/none.csv", empty_ok=True))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_partkey AS item_id, p_name AS name, p_size AS size FROM part")
def json_lines_roundtrip(spark, d):
    """JSON lines written in order, read strictly, with their line numbers."""
    path = new_path(spark, "lines")
    sinks.write_json_lines(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), path, "item_id")
    schema = "item_id long, name string, size int"
    lines = tables.read_lines(spark, path).select("row_idx", F.from_json("value", schema).alias("j"))
    return lines.select("row_idx", "j.item_id").join(tables.read_json_lines(spark, path, schema), "item_id").select("row_idx", "item_id", "name", "size")


_BAD = "CASE WHEN event_id % 7 = 3 THEN substr(props, 1, 4) ELSE props END"


@query(f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, CASE WHEN json_valid({_BAD}) THEN try_cast(json_extract_string({_BAD}, '$.k') AS BIGINT) END AS item_id, json_valid({_BAD}) AS valid FROM events")
def tolerant_json(spark, d):
    """JSON lines of which each seventh is cut short: bad ones are null and aren't valid, the order holds."""
    path = new_path(spark, "tolerant")
    line = F.when(F.col("event_id") % 7 == 3, F.substring("props", 1, 4)).otherwise(F.col("props"))
    table(spark, d, "events").repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return tables.read_predictions(spark, path, "k string").select("row_idx", F.col("parsed.k").try_cast("long").alias("item_id"), "valid")


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE NOT json_valid({_BAD})) AS invalid FROM events")
def invalid_lines(spark, d):
    return tolerant_json(spark, d).agg(F.count("*").alias("n"), F.count(F.when(~F.col("valid"), 1)).alias("invalid"))


@query(f"WITH l AS (SELECT {_BAD} AS value, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events) SELECT row_idx, value FROM l WHERE NOT json_valid(value) ORDER BY row_idx LIMIT 1")
def bad_line(spark, d):
    """The first line of a folder of JSON lines that can't be parsed, and its number, without a sort of the lines."""
    path = new_path(spark, "bad")
    line = F.when(F.col("event_id") % 7 == 3, F.substring("props", 1, 4)).otherwise(F.col("props"))
    table(spark, d, "events").repartitionByRange("event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(path)
    return tables.first_bad_line(spark, path).select("row_idx", "value")


@query("SELECT p_partkey AS item_id, p_name AS dat, p_name || ' é' AS latin1 FROM part")
def separated_files(spark, d):
    """Fields parted by two colons, and CSV in Latin-1."""
    path, part = new_path(spark, "separated"), table(spark, d, "part")
    part.select(F.concat_ws("::", "p_partkey", "p_name").alias("value")).write.text(f"{path}/dat")
    part.select(F.col("p_partkey").alias("item_id"), F.concat("p_name", F.lit(" é")).alias("latin1")).write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/csv")
    dat = tables.read_separated(spark, f"{path}/dat", ["item_id", "dat"]).select(F.col("item_id").cast("long").alias("item_id"), "dat")
    return dat.join(tables.read_latin1(spark, f"{path}/csv").withColumn("item_id", F.col("item_id").cast("long")), "item_id")


@query("SELECT r_regionkey, r_name FROM region")
def json_array(spark, d):
    """One JSON array in a file."""
    path = new_path(spark, "array")
    one = table(spark, d, "region").agg(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("value"))  # five rows
    one.write.text(path)
    return tables.read_json_array(spark, path, "r_regionkey int, r_name string")


@query("SELECT kind, n_name AS category, CASE kind WHEN 'review' THEN 'raw/review_categories/' || n_name || '.jsonl' ELSE 'raw/meta_categories/meta_' || n_name || '.jsonl' END AS path FROM nation, (SELECT unnest(['review', 'meta']) AS kind)")
def catalogue_paths(spark, d):
    one = lambda kind: table(spark, d, "nation").select(F.lit(kind).alias("kind"), F.col("n_name").alias("category"), F.replace(F.lit(tables.reviews_path(kind, "{}")), F.lit("{}"), F.col("n_name")).alias("path"))
    return one("review").union(one("meta"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding]), 6) AS squares FROM embeddings")
def matrix_rows(spark, d):
    """Vectors that all have one length."""
    v = tables.checked_matrix(table(spark, d, "embeddings"))
    return v.select("vec_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6).alias("squares"))


@query(f"WITH {_MET}, f AS (SELECT method FROM met GROUP BY 1 HAVING count(DISTINCT seed) = 25) SELECT method, seed, value FROM met WHERE method IN (SELECT method FROM f)")
def runs_with_all_seeds(spark, d):
    """A tree of metric files by method and seed; methods without a file for each of 25 seeds are left out."""
    path = new_path(spark, "runs")
    _met(spark, d).select("method", "seed", "value").write.partitionBy("method", "seed").json(path)
    rows = tables.read_tree(spark, f"{path}/method=*/seed=*/*.json", "value double", "method=([^/]+)/seed=([0-9]+)/", "method", "seed")
    return tables.with_all(rows.withColumn("seed", F.col("seed").cast("long")), "method", "seed", 25).select("method", "seed", "value")


@query(f"WITH {_MET} SELECT method, arg_max(value, seed) AS balance, max(seed)::DOUBLE AS epoch FROM met GROUP BY 1")
def log_metrics(spark, d):
    """The last [TEST] line of each method's log."""
    path = new_path(spark, "logs")
    line = lambda mark, v: F.concat(F.lit(f"[{mark}] epoch="), F.col("seed").cast("string"), F.lit(" balance="), v.cast("string"))
    lines = _met(spark, d).select("method", "seed", F.explode(F.array(line("VAL", F.lit(0.5)), line("TEST", F.col("value")))).alias("value"))
    lines.repartition("method").sortWithinPartitions("method", "seed", F.col("value").desc()).select("method", "value").write.partitionBy("method").text(path)
    found = tables.last_block(spark, f"{path}/method=*/*.txt", "[TEST]", ["balance", "epoch"])
    return found.select(F.regexp_extract("file", "method=([^/]+)/", 1).alias("method"), "balance", "epoch")


_SO = f"""{_FT}, so AS (SELECT replace(split, 'cold_', 'cold_item_') AS split, user_id, item_id FROM sa UNION ALL SELECT replace(split, 'train', 'emb'), user_id, item_id FROM sa WHERE split LIKE 'warm_train%' UNION ALL SELECT 'cold_item', user_id, item_id FROM sa WHERE split LIKE 'cold%' UNION ALL SELECT 'strict_cold_item_' || substr(split, 6), user_id, item_id FROM sa WHERE split LIKE 'cold%')"""


@query(f"WITH {_SO} SELECT split, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM so GROUP BY 1")
def split_files_roundtrip(spark, d):
    """All named splits and their other names as folders of CSV files, read back and counted."""
    path = new_path(spark, "splits")
    sinks.write_splits(splits.split_outputs(splits.split_tables(pairs(spark, d), "item_id", 30), "item"), path)
    back = spark.read.option("header", True).schema("user long, item long, split string").csv(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("user").alias("users"), F.countDistinct("item").alias("items"))


@query(f"WITH {_SO} SELECT split, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS records FROM so GROUP BY 1")
def split_summary(spark, d):
    """The summary beside the splits: written as JSON, read back, and asked which side is cold."""
    path = new_path(spark, "summary")
    rows = stored(splits.split_outputs(splits.split_tables(pairs(spark, d), "item_id", 30), "item"))
    sinks.write_summary(rows, path, seed=42, cold_object="item", warmup_k=30)
    if tables.cold_side(spark, path) != "item":
        raise ValueError("the summary doesn't tell the cold side")
    return sinks.read_summary(spark, path)


_W = "w AS (SELECT n_nationkey AS shard, count(*) AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)"


@query(f"WITH {IX} SELECT row_number() OVER (ORDER BY user_id, item_id) - 1 AS row_idx, user_id, item_id FROM ix")
def shard_merge(spark, d):
    """Rows dealt to contiguous shards by weight, merged again: counts as in the manifest, the order as before."""
    rows = numbered(pairs(spark, d), "user_id", "item_id", name="row_idx").select((F.col("row_idx") - 1).alias("row_idx"), "user_id", "item_id")
    weights = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("shard")).agg(F.count("*").alias("weight"))
    path = new_path(spark, "shards")
    manifest = sinks.write_shards(rows, f"{path}/parts", weights)
    return sinks.merge_shards(spark, f"{path}/parts", manifest, f"{path}/merged")


@query(f"WITH {IX}, l AS ({segments_sql('(SELECT user_id, item_id FROM ix)', 'user_id', 'item_id')}) SELECT user_id, CAST(coalesce(sum(len(items)) OVER (ORDER BY user_id, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, items FROM l")
def score_export(spark, d):
    """Truth as offsets and items, as a score export holds it, 16 items a row at most."""
    return sinks.ragged(pairs(spark, d), size=16)


_HELD = f"{COLD}, u0 AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS row_idx FROM uv)"


@query(f"WITH {_HELD} SELECT u0.id AS user_id, c.id AS item_id, round(list_dot_product(c.v, u0.v), 6) AS score FROM u0, cold c")
def score_matrices(spark, d):
    """All users' scores of the cold items as a matrix of blocks, a row a user and a column an item in order of ids, read back."""
    cold, users = cold_sides(spark, d)
    columns = stored(numbered(cold, "id", name="pos").select((F.col("pos") - 1).alias("pos"), F.col("id").alias("item_id"), "v"))
    n, path, out = columns.count(), new_path(spark, "scores"), None
    # A matrix for each 1,024 columns, so no row grows with the items.
    for first in range(0, max(1, n), 1_024):
        some = columns.where((F.col("pos") >= first) & (F.col("pos") < first + 1_024))
        matrix_sink.write_matrix(C.score_rows(users, some), f"{path}/{first}", 4_096, in_order=True, digits=6)
        back = matrix_sink.read_matrix_blocks(spark, f"{path}/{first}").select(F.col("id").alias("user_id"), F.posexplode("v").alias("at", "score"))
        rows = back.join(F.broadcast(some.select((F.col("pos") - first).cast("int").alias("at"), "item_id")), "at").select("user_id", "item_id", F.round("score", 6).alias("score"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"WITH {GROUPS}, us AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS row_idx FROM (SELECT DISTINCT user_id FROM ix JOIN grps USING (item_id) WHERE grp = 'strict_cold')) SELECT CAST(row_idx AS BIGINT) AS row_idx, item_id FROM ix JOIN us USING (user_id) JOIN grps USING (item_id) WHERE grp <> 'strict_cold'")
def exclude_coordinates(spark, d):
    """Cells of a score matrix that ranking leaves out: positives of its users that aren't the truth, by row and item."""
    rows = grouped_pairs(spark, d)
    truth = rows.where("grp = 'strict_cold'").select("user_id", "item_id")
    return sinks.exclude_coordinates(rows.select("user_id", "item_id"), truth)


def _fixed_sql(x: str) -> str:
    w = f"CAST(floor({x} * 100 + 0.5) AS BIGINT)"
    return f"(CAST({w} // 100 AS VARCHAR) || '.' || lpad(CAST({w} % 100 AS VARCHAR), 2, '0'))"


@query(f"WITH {_MET}, m AS (SELECT method, round(avg(abs(value)), 6) AS m, round(coalesce(stddev_samp(abs(value)), 0), 6) AS s, count(*) AS n FROM met GROUP BY 1) SELECT method, '| ' || method || ' | ' || {_fixed_sql('m')} || ' ± ' || {_fixed_sql('s')} || ' | ' || n || ' |' AS markdown, method || ' & ' || {_fixed_sql('m')} || ' & ' || {_fixed_sql('s')} || ' \\\\' AS latex FROM m")
def report_rows(spark, d):
    """Rows of a report in Markdown and LaTeX: mean and deviation of two digits."""
    m = stats.seed_summary(_met(spark, d).withColumn("value", F.abs("value")))
    mean, sd = sinks.fixed(F.col("mean"), 2), sinks.fixed(F.col("sd"), 2)
    return m.select("method", sinks.markdown_row(F.col("method"), F.concat(mean, F.lit(" ± "), sd), F.col("n").cast("string")).alias("markdown"), sinks.latex_row(F.col("method"), mean, sd).alias("latex"))


@query(f"WITH {_PR}, z AS (SELECT row_number() OVER (ORDER BY user_id, item_id) - 1 AS row_idx, user_id, item_id, t AS predict FROM pt) SELECT * FROM z")
def predictions_zip(spark, d):
    """Candidates and a file of predictions, joined line by line."""
    p = stored(_predictions(spark, d))
    path = new_path(spark, "predictions")
    sinks.write_json_lines(p.select("user_id", "item_id", F.col("t").alias("predict")), path, "user_id", "item_id")
    candidates = numbered(p.select("user_id", "item_id"), "user_id", "item_id", name="row_idx").withColumn("row_idx", F.col("row_idx") - 1)
    found = tables.read_predictions(spark, path, "predict string").select("row_idx", "parsed.predict")
    return tables.zipped(candidates, found).select("row_idx", "user_id", "item_id", "predict")


@query(f"WITH {IX}, u AS (SELECT 'user' AS side, user_id AS id, item_id AS other FROM ix UNION ALL SELECT 'item', item_id, user_id FROM ix) {segments_sql('u', 'side, id', 'other', 'others')}")
def converted_roundtrip(spark, d):
    """Neighbour maps of users and items in segments of 16, stored as a table and read again."""
    p = pairs(spark, d)
    side = lambda name, a, b: p.select(F.lit(name).alias("side"), F.col(a).alias("id"), F.col(b).alias("other"))
    return stored(segments(side("user", "user_id", "item_id").union(side("item", "item_id", "user_id")), "other", "side", "id", size=16, name="others"))
