"""Queries over sources, filters, splits, conversion, text and numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frostline.functions import text
from frostline.operators import complement, filters, splits
from frostline.operators.ids import dense_remap, hash_order, numbered, segments
from frostline.plans.base import GROUPS, IX, groups_sql, h, interactions, item_groups, pairs, query
from frostline.sources.storage import stored
from frostline.sources.tables import table


@query(f"WITH {IX} SELECT user_id, item_id, ts, rating FROM ix")
def interactions_dedup(spark, d):
    return interactions(spark, d)


@query(f"WITH {IX} SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(*) AS n FROM ix")
def split_stats(spark, d):
    return pairs(spark, d).agg(F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.count("*").alias("n"))


@query(f"WITH {IX} SELECT round((count(DISTINCT user_id) * count(DISTINCT item_id) - count(*)) * 100.0::DOUBLE / (count(DISTINCT user_id) * count(DISTINCT item_id)), 6) AS sparsity FROM ix")
def sparsity(spark, d):
    u, i = F.countDistinct("user_id"), F.countDistinct("item_id")
    return pairs(spark, d).agg(F.round((u * i - F.count("*")) * 100.0 / (u * i), 6).alias("sparsity"))


@query(f"WITH {IX} SELECT max(user_id) + 1 AS n_users, max(item_id) + 1 AS n_items FROM ix")
def entity_counts(spark, d):
    return pairs(spark, d).agg((F.max("user_id") + 1).alias("n_users"), (F.max("item_id") + 1).alias("n_items"))


@query(f"WITH {IX} SELECT user_id, item_id, dense_rank() OVER (ORDER BY item_id) - 1 AS item_no FROM ix")
def dense_remap_items(spark, d):
    return dense_remap(pairs(spark, d), "item_id", "item_no").select("user_id", "item_id", "item_no")


_CORE_ROUNDS = 12


def _core_sql(min_user: int, min_item: int) -> str:
    steps, at = [f"c0 AS (SELECT user_id, item_id FROM ix)"], "c0"
    for k in range(_CORE_ROUNDS):
        steps.append(f"c{k}u AS MATERIALIZED (SELECT * FROM {at} WHERE user_id IN (SELECT user_id FROM {at} GROUP BY 1 HAVING count(*) >= {min_user}))")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT * FROM c{k}u WHERE item_id IN (SELECT item_id FROM c{k}u GROUP BY 1 HAVING count(*) >= {min_item}))")
        at = f"c{k + 1}"
    return f"WITH {IX}, {', '.join(steps)} SELECT user_id, item_id FROM {at}"


@query(_core_sql(28, 20))
def kcore_filter(spark, d):
    return filters.iterative_core(pairs(spark, d), 28, 20)


_EV = "ev AS (SELECT event_id, ts, user_id, event_type, value, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("item_id", F.get_json_object("props", "$.k").try_cast("long"))


@query(f"WITH {_EV} SELECT event_id, user_id, item_id, value FROM ev WHERE value >= 4 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' AND lower(trim(event_type)) <> '' AND item_id IS NOT NULL")
def review_filters(spark, d):
    e = _events(spark, d).where((F.col("value") >= 4) & F.col("ts").between(F.to_timestamp(F.lit("2024-01-03")), F.to_timestamp(F.lit("2024-01-20"))))
    return e.where(filters.first_key("event_type").isNotNull() & F.col("item_id").isNotNull()).select("event_id", "user_id", "item_id", "value")


@query("SELECT event_id, epoch_us(ts) // CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 1000000 END AS raw, make_timestamp(CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000) * 1000 ELSE (epoch_us(ts) // 1000000) * 1000000 END) AS at FROM events")
def epoch_unit(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.unix_millis(F.col("ts").cast("timestamp"))).otherwise(F.unix_seconds(F.col("ts").cast("timestamp"))).cast("long")
    return table(spark, d, "events").withColumn("raw", raw).select("event_id", "raw", filters.epoch_time(F.col("raw")).alias("at"))


@query(f"WITH {_EV} SELECT event_id, item_id FROM ev")
def json_field(spark, d):
    return _events(spark, d).select("event_id", "item_id")


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' WHEN ts < TIMESTAMP '2024-01-22' THEN 'val' WHEN ts <= TIMESTAMP '2024-01-28' THEN 'test' ELSE 'drop' END AS period FROM events")
def calendar_period(spark, d):
    day = lambda s: F.to_timestamp(F.lit(s))
    p = F.when(F.col("ts") < day("2024-01-15"), "train").when(F.col("ts") < day("2024-01-22"), "val").when(F.col("ts") <= day("2024-01-28"), "test").otherwise("drop")
    return table(spark, d, "events").select("event_id", p.alias("period"))


_TP = f"""{_EV}, tr AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM ev),
tb AS (SELECT *, least(greatest(CAST(floor(n * 0.6) AS BIGINT), 1), greatest(n - 2, 1)) AS a FROM tr),
tc AS (SELECT *, least(greatest(CAST(floor(n * 0.8) AS BIGINT), a + 1), greatest(n - 1, a + 1)) AS b FROM tb),
td AS (SELECT *, CASE WHEN r <= a THEN 'train' WHEN r <= b THEN 'val' ELSE 'test' END AS p0 FROM tc),
tx AS (SELECT min(r) AS r FROM td WHERE p0 <> 'train' AND user_id NOT IN (SELECT user_id FROM td WHERE p0 = 'train') GROUP BY user_id),
tp AS (SELECT event_id, user_id, item_id, CASE WHEN r IN (SELECT r FROM tx) THEN 'train' ELSE p0 END AS part FROM td)"""


def _temporal(spark, d):
    return splits.temporal_parts(_events(spark, d).withColumn("row_idx", F.col("event_id")), "user_id")


@query(f"WITH {_TP} SELECT event_id, part FROM tp")
def relative_period(spark, d):
    return _temporal(spark, d).select("event_id", "part")


_TG = f"{_TP}, tg AS (SELECT item_id, count(*) FILTER (WHERE part = 'train') AS n_train FROM tp WHERE item_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE part <> 'train') > 0), tgg AS (SELECT item_id, n_train, CASE WHEN n_train = 0 THEN 'strict_cold' WHEN n_train < 60 THEN 'warmup' ELSE 'warm' END AS grp FROM tg)"


def _temporal_groups(spark, d):
    return splits.temporal_groups(_temporal(spark, d).where("item_id is not null"), "item_id", 60)


@query(f"WITH {_TG} SELECT * FROM tgg")
def temporal_groups(spark, d):
    return _temporal_groups(spark, d)


@query(f"""WITH {_TG}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {h('item_id', 42)}, item_id) AS k FROM tgg),
l AS (SELECT *, CASE WHEN (grp = 'strict_cold' AND k <= 12) OR (grp = 'warmup' AND k <= 9) THEN 0 WHEN grp = 'warm' THEN 1 ELSE 2 END AS level FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY level, grp, k, item_id) AS place FROM l) SELECT item_id, grp FROM o WHERE place <= 30""")
def eval_entity_sample(spark, d):
    return splits.evaluation_sample(_temporal_groups(spark, d), "item_id", 30)


@query(f"WITH {GROUPS} SELECT item_id, degree, grp FROM grps")
def entity_partition_item(spark, d):
    return item_groups(spark, d)


@query(f"WITH {IX}, {groups_sql('user_id', 40)} SELECT user_id, degree, grp FROM grps")
def entity_partition_user(spark, d):
    return splits.entity_groups(pairs(spark, d), "user_id", k0=40)


_PAIR = "user_id || '-' || item_id"
_WARM = f"{GROUPS}, w AS (SELECT user_id, item_id FROM ix JOIN grps USING (item_id) WHERE grp = 'warm'), wr AS (SELECT *, row_number() OVER (ORDER BY {h(_PAIR, 42)}, user_id, item_id) AS r, count(*) OVER () AS n FROM w), wp AS (SELECT user_id, item_id, CASE WHEN r <= n // 10 THEN 'val' WHEN r <= 2 * (n // 10) THEN 'test' ELSE 'train' END AS part FROM wr)"


def _of(spark, d, grp):
    groups = stored(item_groups(spark, d).where(F.col("grp") == grp).select("item_id"))
    return pairs(spark, d).join(groups, "item_id", "left_semi").select("user_id", "item_id")


@query(f"WITH {_WARM} SELECT * FROM wp")
def warm_split(spark, d):
    return splits.warm_rows(_of(spark, d, "warm"))


def _repair_sql() -> str:
    out, at = [], "wp"
    for k, (part, col) in enumerate((p, c) for p in ("val", "test") for c in ("user_id", "item_id")):
        out.append(f"v{k} AS MATERIALIZED (SELECT user_id, item_id, CASE WHEN part = '{part}' AND {col} NOT IN (SELECT {col} FROM {at} WHERE part = 'train') THEN 'train' ELSE part END AS part FROM {at})")
        at = f"v{k}"
    return f"{_WARM}, {', '.join(out)}"


@query(f"WITH {_repair_sql()} SELECT * FROM v3")
def visibility_repair(spark, d):
    return splits.repair_visibility(splits.warm_rows(_of(spark, d, "warm")))


_SUP = f"""{_repair_sql()}, m AS (SELECT user_id, item_id FROM ix JOIN grps USING (item_id) WHERE grp = 'warmup'),
mr AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY {h(_PAIR, 42)}, user_id) AS r, 1 + {h('item_id', '42s')} % 29 AS s FROM m),
mp AS (SELECT user_id, item_id, CASE WHEN r <= s THEN 'support' WHEN r <= s + (n - s) // 2 THEN 'val' ELSE 'test' END AS part FROM mr WHERE n >= 31 AND (n - s) // 2 >= 1 AND n - s - (n - s) // 2 >= 1)"""


@query(f"WITH {_SUP} SELECT * FROM mp")
def warmup_support(spark, d):
    return splits.warmup_support(_of(spark, d, "warmup"), "item_id", 30)


_FT = f"""{_SUP}, ft AS (SELECT user_id, item_id FROM v3 WHERE part = 'train' UNION SELECT user_id, item_id FROM mp WHERE part = 'support'),
c AS (SELECT user_id, item_id FROM ix JOIN grps USING (item_id) WHERE grp = 'strict_cold' AND user_id IN (SELECT user_id FROM ft)),
ce AS (SELECT item_id, row_number() OVER (ORDER BY {h('item_id', '42c')}, item_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT item_id FROM c)),
cp AS (SELECT user_id, item_id, CASE WHEN n >= 2 AND r <= least(greatest(n // 2, 1), n - 1) THEN 'val' ELSE 'test' END AS part FROM c JOIN ce USING (item_id)),
st AS (SELECT 'warm_train' AS split, user_id, item_id FROM ft UNION ALL SELECT 'warm_train_original', user_id, item_id FROM v3 WHERE part = 'train' UNION ALL SELECT 'warmup_support', user_id, item_id FROM mp WHERE part = 'support'
 UNION ALL SELECT 'warm_' || part, user_id, item_id FROM v3 WHERE part <> 'train' UNION ALL SELECT 'warmup_' || part, user_id, item_id FROM mp WHERE part <> 'support' AND user_id IN (SELECT user_id FROM ft) UNION ALL SELECT 'cold_' || part, user_id, item_id FROM cp),
sa AS (SELECT * FROM st UNION ALL SELECT 'overall_' || regexp_extract(split, '(val|test)$', 1), user_id, item_id FROM st WHERE split LIKE '%_val' OR split LIKE '%_test')"""


@query(f"WITH {_FT} SELECT * FROM sa")
def split_tables(spark, d):
    return splits.split_tables(pairs(spark, d), "item_id", 30)


@query(f"WITH {_FT} SELECT split, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM sa GROUP BY 1")
def split_counts(spark, d):
    return splits.split_tables(pairs(spark, d), "item_id", 30).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"))


def segments_sql(source: str, by: str, value: str, name: str = "items", size: int = 16) -> str:
    """SQL of ``ids.segments`` over distinct (by, value)."""
    return f"SELECT {by}, r // {size} AS segment, any_value(n) AS degree, list_sort(list({value})) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS n FROM {source}) GROUP BY ALL"


@query(f"WITH {IX} {segments_sql('(SELECT user_id, item_id FROM ix)', 'user_id', 'item_id')}")
def neighbor_lists(spark, d):
    """Items of each user in order, in segments of 16, and how many there are."""
    return segments(pairs(spark, d), "item_id", "user_id", size=16)


@query(f"WITH {IX} SELECT range AS item_id FROM range((SELECT max(item_id) + 1 FROM ix)) WHERE range NOT IN (SELECT item_id FROM ix)")
def complement_ids(spark, d):
    seen = pairs(spark, d).select("item_id").distinct()
    n = seen.agg(F.max("item_id")).first()[0]
    return spark.range(0, (n if n is not None else -1) + 1).select(F.col("id").alias("item_id")).join(seen, "item_id", "left_anti")


@query(f"WITH {_WARM} SELECT user_id, item_id FROM wp WHERE part = 'test' AND user_id IN (SELECT user_id FROM wp WHERE part = 'val' INTERSECT SELECT user_id FROM wp WHERE part = 'train')")
def contained_in_both(spark, d):
    rows = stored(splits.warm_rows(_of(spark, d, "warm")))
    part = lambda p: rows.where(F.col("part") == p).select("user_id", "item_id")
    return filters.contained_in_both(part("test"), part("val"), part("train"), "user_id")


_HIST = f"{IX}, hr AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS r FROM ix)"


@query(f"WITH {_HIST}, f AS (SELECT user_id, item_id, r, max(r) OVER (PARTITION BY user_id) AS last FROM hr WHERE r <= 20) SELECT c_custkey AS user_id, coalesce(string_agg(p_name, ',' ORDER BY r) FILTER (WHERE r < last), 'default info') AS history FROM customer LEFT JOIN f ON user_id = c_custkey LEFT JOIN part ON p_partkey = item_id GROUP BY 1")
def preference_text(spark, d):
    """Titles of a user's first 20 items by time without the last of them; a default where there are none."""
    w = Window.partitionBy("user_id").orderBy("ts", "item_id")
    first = interactions(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 20")
    titled = first.join(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name"), "item_id", "left")
    lists = titled.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("r", "p_name"))).alias("t"))
    joined = lists.select("user_id", F.nullif(F.array_join(F.transform(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), lambda x: x["p_name"]), ","), F.lit("")).alias("history"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(joined, "user_id", "left").select("user_id", F.coalesce("history", F.lit("default info")).alias("history"))


def drawn_negatives(positives, items, ratio=1):
    """(user_id, item_id): for each user min(ratio * positives, unseen items) items that the user hasn't met, none twice.

    ``positives`` are distinct pairs.  Items are drawn from the unseen ones by rank (``complement.sampled_unmet``).
    """
    needs = positives.groupBy("user_id").agg((F.count("*") * ratio).alias("need"))
    return complement.sampled_unmet(needs, positives, items, "user_id", "item_id", hash_order(F.concat_ws("-", "user_id", "_k"), "d"))


@query("SELECT p_partkey AS item_id, 'Would the user like the product titled \"' || p_name || '\" (' || p_brand || ')?' AS prompt FROM part")
def prompt_render(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.concat(F.lit('Would the user like the product titled "'), "p_name", F.lit('" ('), "p_brand", F.lit(")?")).alias("prompt"))


@query("""SELECT item_id, t AS template, CASE t WHEN 'legacy' THEN '[INST] ' || x || ' [/INST] ' WHEN 'llama3' THEN '<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || x || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) ELSE '<|im_start|>user' || chr(10) || x || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) END AS prompt
FROM (SELECT p_partkey AS item_id, 'Judge the product.' || chr(10) || p_name AS x FROM part), (SELECT unnest(['legacy', 'llama3', 'qwen']) AS t)""")
def chat_templates(spark, d):
    forms = F.array(*[F.struct(F.lit(t).alias("template"), text.chat(t, F.lit("Judge the product."), F.col("p_name")).alias("prompt")) for t in ("legacy", "llama3", "qwen")])
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.explode(forms).alias("x")).select("item_id", "x.template", "x.prompt")


@query("SELECT p_partkey AS item_id, lower(p_name) || ' ' || array_to_string(['genre_' || regexp_replace(regexp_replace(lower(g), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') FOR g IN string_split(p_type, ' ')], ' ') AS doc FROM part")
def doc_tokens(spark, d):
    genres = F.transform(F.split("p_type", " "), lambda g: F.concat(F.lit("genre_"), text.token(g)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.concat(F.lower("p_name"), F.lit(" "), F.array_join(genres, " ")).alias("doc"))


@query("SELECT c_custkey AS user_id, 'A customer from ' || n_name || ' in the ' || lower(c_mktsegment) || ' segment' AS profile FROM customer JOIN nation ON c_nationkey = n_nationkey")
def profile_text(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation").select("n_nationkey", "n_name")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("A customer from "), "n_name", F.lit(" in the "), F.lower("c_mktsegment"), F.lit(" segment")).alias("profile"))


_PR = f"{IX}, pr AS (SELECT user_id, item_id, {h(_PAIR, 'x')} % 8 AS b, CAST(({h(_PAIR, 'y')} % 101) / 100.0::DOUBLE AS VARCHAR) AS v FROM ix), pt AS (SELECT user_id, item_id, CASE b WHEN 0 THEN v WHEN 1 THEN 'prob is ' || v || '.' WHEN 2 THEN '1' WHEN 3 THEN 'N/A' WHEN 4 THEN '1.5 stars' WHEN 5 THEN '' WHEN 6 THEN '10' ELSE 'nan' END AS t FROM pr)"


def _predictions(spark, d):
    """Texts that a scorer might return: bare numbers, sentences, out of range, none."""
    key = F.concat_ws("-", "user_id", "item_id")
    b, v = hash_order(key, "x") % 8, ((hash_order(key, "y") % 101) / 100.0).cast("string")
    t = F.when(b == 0, v).when(b == 1, F.concat(F.lit("prob is "), v, F.lit("."))).when(b == 2, "1").when(b == 3, "N/A").when(b == 4, "1.5 stars").when(b == 5, "").when(b == 6, "10").otherwise("nan")
    return pairs(spark, d).select("user_id", "item_id", t.alias("t"))


#: The forms without lookarounds, which consume their neighbours.
_FORM_SQL = {
    "a": r"(?:^|[^0-9.])(0(?:\.[0-9]+)?|1(?:\.0+)?)(?:[^0-9]|$)",
    "b": r"(?:^|[^0-9])(0(?:\.[0-9]+)?|1(?:\.0+)?)(?:[^0-9]|$)",
    "d": r"(?:^|[^0-9.])(0\.[0-9]+|1(?:\.0+)?|0)(?:[^0-9]|$)",
}


def _parse(form):
    if form == "c":
        sql = f"WITH {_PR} SELECT user_id, item_id, coalesce(try_cast(nullif(regexp_extract(t, '(?:^|[^0-9.])(0\\.[0-9]+|1\\.0+)(?:[^0-9]|$)', 1), '') AS DOUBLE), CASE WHEN trim(t) IN ('0', '1') THEN CAST(trim(t) AS DOUBLE) END, 0.5) AS p FROM pt"
    else:
        inner = f"try_cast(nullif(regexp_extract(t, '{_FORM_SQL[form]}', 1), '') AS DOUBLE)"
        sql = f"WITH {_PR}, q AS (SELECT user_id, item_id, coalesce(try_cast(nullif(trim(t), '') AS DOUBLE), {inner}) AS p FROM pt) SELECT user_id, item_id, CASE WHEN NOT isnan(p) AND p BETWEEN 0 AND 1 THEN p END AS p FROM q"

    @query(sql, f"parse_prob_{form}")
    def parse(spark, d):
        return _predictions(spark, d).select("user_id", "item_id", text.parse_probability(F.col("t"), form, 0.5).alias("p"))


for _form in "abcd":
    _parse(_form)


@query("SELECT event_id, props FROM events WHERE event_id < (SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE event_id % 977 = 976 OR NOT json_valid(props))")
def valid_prefix(spark, d):
    """Rows before the first bad one (every 977th is taken to be cut short)."""
    e = table(spark, d, "events").withColumn("line", F.when(F.col("event_id") % 977 == 976, F.lit("{")).otherwise(F.col("props")))
    bad = e.where(F.get_json_object("line", "$").isNull()).agg(F.coalesce(F.min("event_id"), F.lit(2**63 - 1)).alias("stop"))
    return e.join(F.broadcast(bad), F.col("event_id") < F.col("stop")).select("event_id", "props")


@query(f"WITH {IX}, q AS (SELECT quantile_cont(n, 0.8) AS cut FROM (SELECT count(*) AS n FROM ix GROUP BY item_id)) SELECT item_id, count(*) AS n FROM ix GROUP BY 1 HAVING count(*) >= (SELECT cut FROM q)")
def head_share(spark, d):
    from frostline.operators.evaluate import head_entities

    return head_entities(pairs(spark, d), "item_id")


@query(f"WITH {IX}, g AS (SELECT item_id, count(*) AS n FROM ix GROUP BY 1) SELECT item_id, round(ln(1.0::DOUBLE + n) / max(ln(1.0::DOUBLE + n)) OVER (), 6) AS popularity FROM g")
def popularity(spark, d):
    g = pairs(spark, d).groupBy("item_id").agg(F.log1p(F.count("*").cast("double")).alias("l"))
    return g.join(F.broadcast(g.agg(F.max("l").alias("m"))), F.lit(True)).select("item_id", F.round(F.col("l") / F.col("m"), 6).alias("popularity"))


@query(f"WITH {IX}, g AS (SELECT count(*)::DOUBLE AS n FROM ix GROUP BY user_id) SELECT count(*) AS groups, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS sd, min(n) AS low, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS high FROM g")
def describe_degrees(spark, d):
    n = F.col("n")
    g = pairs(spark, d).groupBy("user_id").agg(F.count("*").cast("double").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("sd"), F.min(n).alias("low"), *[F.percentile(n, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max(n).alias("high"))


@query(f"WITH {IX} SELECT user_id, item_id, row_number() OVER (ORDER BY rating DESC, user_id, item_id) AS row_idx FROM ix")
def row_numbers(spark, d):
    return numbered(interactions(spark, d).select("user_id", "item_id", "rating"), F.col("rating").desc(), "user_id", "item_id", name="row_idx").select("user_id", "item_id", "row_idx")
