"""Queries over prepared data sets, examples for tuning, probes and learned factors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frostline.functions import text
from frostline.operators import complement, evaluate, factors, filters, graph, models, splits, towers
from frostline.operators.ids import dense_remap, hash_order, hash_uniform, numbered, segments
from frostline.plans.base import GROUPS, IX, SP, h, interactions, item_groups, pairs, part_terms, query, scored_pairs, vectors
from frostline.plans.data import _CORE_ROUNDS, _FT, _WARM, drawn_negatives, segments_sql
from frostline.plans.measures import _NORM, _edges
from frostline.sources.storage import stored
from frostline.sources.tables import table

_K = "user_id || '-' || item_id"


@query(f"WITH {IX}, f AS (SELECT user_id, item_id FROM ix WHERE rating >= 25), m AS (SELECT *, dense_rank() OVER (ORDER BY user_id) - 1 AS user_no, dense_rank() OVER (ORDER BY item_id) - 1 AS item_no FROM f) SELECT m.*, p_name AS title, 'genre_' || lower(replace(p_type, ' ', ' genre_')) AS genres FROM m JOIN part ON p_partkey = item_id")
def prepared_movies(spark, d):
    """Ratings above a threshold with dense ids, titles and genre tokens."""
    kept = interactions(spark, d).where("rating >= 25").select("user_id", "item_id")
    dense = dense_remap(dense_remap(kept, "user_id", "user_no"), "item_id", "item_no")
    meta = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.array_join(F.transform(F.split("p_type", " "), lambda g: F.concat(F.lit("genre_"), text.token(g))), " ").alias("genres"))
    return dense.join(meta, "item_id").select("user_id", "item_id", "user_no", "item_no", "title", "genres")


def _reviews_core() -> str:
    steps, at = [], "c0"
    for k in range(_CORE_ROUNDS):
        steps.append(f"c{k}u AS MATERIALIZED (SELECT * FROM {at} WHERE user_id IN (SELECT user_id FROM {at} GROUP BY 1 HAVING count(*) >= 20))")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT * FROM c{k}u WHERE item_id IN (SELECT item_id FROM c{k}u GROUP BY 1 HAVING count(*) >= 5))")
        at = f"c{k + 1}"
    return ", ".join(steps) + f", core AS (SELECT * FROM {at})"


_PREP = f"""e AS (SELECT user_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS item_id, min(ts) AS ts, min(event_id) AS event_id FROM events WHERE value >= 2 AND ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2), c0 AS (SELECT * FROM e WHERE item_id % 7 <> 0), {_reviews_core()},
dn AS (SELECT *, dense_rank() OVER (ORDER BY user_id) - 1 AS user_no, dense_rank() OVER (ORDER BY item_id) - 1 AS item_no, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM core), ab AS (SELECT *, least(greatest(CAST(floor(n * 0.6) AS BIGINT), 1), greatest(n - 2, 1)) AS a FROM dn), bb AS (SELECT *, least(greatest(CAST(floor(n * 0.8) AS BIGINT), a + 1), greatest(n - 1, a + 1)) AS b FROM ab),
p0 AS (SELECT *, CASE WHEN r <= a THEN 'train' WHEN r <= b THEN 'val' ELSE 'test' END AS part0 FROM bb), an AS (SELECT min(r) AS r FROM p0 WHERE part0 <> 'train' AND user_no NOT IN (SELECT user_no FROM p0 WHERE part0 = 'train') GROUP BY user_no), tp AS (SELECT event_id, user_no, item_no, CASE WHEN r IN (SELECT r FROM an) THEN 'train' ELSE part0 END AS part FROM p0),
tg AS (SELECT item_no, count(*) FILTER (WHERE part = 'train') AS n_train FROM tp GROUP BY 1 HAVING count(*) FILTER (WHERE part <> 'train') > 0)"""


@query(f"WITH {_PREP} SELECT event_id, user_no, item_no, part, CASE WHEN n_train = 0 THEN 'strict_cold' WHEN n_train < 20 THEN 'warmup' ELSE 'warm' END AS grp FROM tp JOIN tg USING (item_no)")
def prepared_reviews(spark, d):
    """Reviews from the log to parts: filters, items with metadata, iterative core, dense ids, split by time, groups."""
    dense = _review_core(spark, d).select(F.col("user_id").alias("user_no"), F.col("item_id").alias("item_no"), "ts", "row_idx")
    parts = stored(splits.temporal_parts(dense, "user_no"))
    return parts.join(splits.temporal_groups(parts, "item_no", 20), "item_no").select(F.col("row_idx").alias("event_id"), "user_no", "item_no", "part", "grp")


def _review_core(spark, d):
    """(user_id, item_id, raw_item, ts, row_idx): reviews that pass the filters and the iterative core, under dense ids."""
    e = table(spark, d, "events").withColumn("item_id", F.get_json_object("props", "$.k").try_cast("long"))
    kept = e.where((F.col("value") >= 2) & (F.col("ts") < F.to_timestamp(F.lit("2024-01-29")))).groupBy("user_id", "item_id").agg(F.min("ts").alias("ts"), F.min("event_id").alias("event_id"))
    core = filters.iterative_core(kept.where("item_id % 7 <> 0"), 20, 5)
    dense = dense_remap(dense_remap(core, "user_id", "user_no"), "item_id", "item_no")
    return stored(dense.select(F.col("user_no").alias("user_id"), F.col("item_no").alias("item_id"), F.col("item_id").alias("raw_item"), "ts", F.col("event_id").alias("row_idx")))


def _resplit(source: str) -> str:
    """SQL of a split by time of ``source`` (user_no, item_no, r): z4 (user_no, item_no, part)."""
    return f"""z0 AS (SELECT user_no, item_no, row_number() OVER (ORDER BY r) AS r, count(*) OVER () AS n FROM {source}), z1 AS (SELECT *, least(greatest(CAST(floor(n * 0.6) AS BIGINT), 1), greatest(n - 2, 1)) AS a FROM z0), z2 AS (SELECT *, least(greatest(CAST(floor(n * 0.8) AS BIGINT), a + 1), greatest(n - 1, a + 1)) AS b FROM z1), z3 AS (SELECT *, CASE WHEN r <= a THEN 'train' WHEN r <= b THEN 'val' ELSE 'test' END AS part0 FROM z2),
zn AS (SELECT min(r) AS r FROM z3 WHERE part0 <> 'train' AND user_no NOT IN (SELECT user_no FROM z3 WHERE part0 = 'train') GROUP BY user_no), z4 AS (SELECT user_no, item_no, CASE WHEN r IN (SELECT r FROM zn) THEN 'train' ELSE part0 END AS part FROM z3)"""


_WHOLE = f"""{_PREP}, tr AS (SELECT event_id, r FROM p0), gg AS (SELECT item_no, CASE WHEN n_train = 0 THEN 'strict_cold' WHEN n_train < 20 THEN 'warmup' ELSE 'warm' END AS grp FROM tg), gk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {h('item_no', 42)}, item_no) AS k FROM gg), gl AS (SELECT *, CASE WHEN (grp = 'strict_cold' AND k <= 16) OR (grp = 'warmup' AND k <= 12) THEN 0 WHEN grp = 'warm' THEN 1 ELSE 2 END AS level FROM gk), go AS (SELECT *, row_number() OVER (ORDER BY level, grp, k, item_no) AS place FROM gl),
kp AS (SELECT user_no, item_no, r FROM tp JOIN tr USING (event_id) WHERE part = 'train' OR item_no IN (SELECT item_no FROM go WHERE place <= 40) OR (SELECT count(*) FROM gg) <= 40), {_resplit('kp')},
vs AS (SELECT user_no, item_no, part FROM z4 WHERE part = 'train' OR user_no IN (SELECT user_no FROM z4 WHERE part = 'train')), ng AS (SELECT item_no, count(*) FILTER (WHERE part = 'train') AS n_train FROM vs GROUP BY 1 HAVING count(*) FILTER (WHERE part <> 'train') > 0), vg AS (SELECT vs.*, CASE WHEN n_train = 0 THEN 'cold_item' WHEN n_train < 20 THEN 'warmup' ELSE 'warm' END AS g FROM vs JOIN ng USING (item_no)),
sp AS (SELECT CASE WHEN part <> 'train' THEN g || '_' || part WHEN g = 'warm' THEN 'warm_train_original' ELSE 'warmup_support' END AS split, user_no, item_no FROM vg UNION ALL SELECT CASE WHEN part = 'train' THEN 'train' ELSE 'overall_' || part END, user_no, item_no FROM vg UNION ALL SELECT 'cold_item', user_no, item_no FROM vg WHERE g = 'cold_item' AND part <> 'train'),
un AS (SELECT user_no, dense_rank() OVER (ORDER BY user_no) - 1 AS user_id FROM (SELECT DISTINCT user_no FROM z4)), im AS (SELECT item_no, dense_rank() OVER (ORDER BY item_no) - 1 AS item_id FROM (SELECT DISTINCT item_no FROM z4))"""


@query(f"WITH {_WHOLE} SELECT split, user_id, item_id FROM sp JOIN un USING (user_no) JOIN im USING (item_no)")
def prepared_whole(spark, d):
    """Reviews from the log to splits: filters, metadata, iterative core, dense ids, split by time, a sample of evaluated items, the split and the ids anew."""
    return splits.sampled_temporal_tables(_review_core(spark, d), 40, 20)[0]


@query()
def prepared_content(spark, d):
    """Text vectors of the items that the whole preparation keeps, by their last ids."""
    core = _review_core(spark, d)
    _, _, items = splits.sampled_temporal_tables(core, 40, 20)
    raw = core.select("item_id", "raw_item").distinct().join(items, "item_id").select("item_no", "raw_item")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("raw_item"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return models.text_factors(raw.join(parts, "raw_item", "left").select(F.col("item_no").alias("id"), "text"), 16)


def _entity_sql(side: str) -> str:
    c = f"{side}_id"
    in_ = lambda x: f"{c} IN (SELECT {c} FROM sa WHERE {x})"
    warm, warmup = in_("split IN ('warm_train_original', 'warm_val', 'warm_test')"), in_("split IN ('warmup_support', 'warmup_val', 'warmup_test')")
    strict = f"NOT {warm} AND NOT {warmup}" if side == "item" else in_("split IN ('cold_val', 'cold_test')")
    kinds = {"warm": warm, "warmup": warmup, "strict_cold": strict, "pure_cold": f"NOT {warm}", "mixed_warm": in_("split = 'warm_train'"), "mixed_cold": "NOT " + in_("split = 'warm_train'")}
    return " UNION ALL ".join(f"SELECT '{side}' AS side, '{k}' AS kind, {c} AS id FROM every_{side} WHERE {w}" for k, w in kinds.items())


@query(f"WITH {_FT}, every_user AS (SELECT range AS user_id FROM range((SELECT max(user_id) + 1 FROM ix))), every_item AS (SELECT range AS item_id FROM range((SELECT max(item_id) + 1 FROM ix))) {_entity_sql('user')} UNION ALL {_entity_sql('item')}")
def entity_lists(spark, d):
    """Users and items by kind: warm, warm-up and strict cold, and seen or not by the graph with or without support.

    Items are the cold side: all ids that are neither warm nor warm-up are strict cold.
    """
    p = stored(pairs(spark, d))
    sa = stored(splits.split_tables(p, "item_id", 30))
    out = None
    for side in ("user", "item"):
        c = f"{side}_id"
        n = p.agg(F.coalesce(F.max(c) + 1, F.lit(0))).first()[0]
        of = lambda *names: sa.where(F.col("split").isin(*names)).select(F.col(c).alias("id")).distinct()  # noqa: E731, B023
        flags = spark.range(n)
        for name, ids in {"warm": of("warm_train_original", "warm_val", "warm_test"), "warmup": of("warmup_support", "warmup_val", "warmup_test"), "cold": of("cold_val", "cold_test"), "mixed": of("warm_train")}.items():
            flags = flags.join(ids.withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
        strict = ~F.col("warm") & ~F.col("warmup") if side == "item" else F.col("cold")
        kinds = {"warm": F.col("warm"), "warmup": F.col("warmup"), "strict_cold": strict, "pure_cold": ~F.col("warm"), "mixed_warm": F.col("mixed"), "mixed_cold": ~F.col("mixed")}
        one = flags.select(F.lit(side).alias("side"), F.explode(F.array_compact(F.array(*[F.when(w, F.lit(k)) for k, w in kinds.items()]))).alias("kind"), "id")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {_FT}, t AS (SELECT split, user_id, item_id FROM sa WHERE split LIKE 'warm_train%'), u AS (SELECT split, 'user' AS side, user_id AS id, item_id AS other FROM t UNION ALL SELECT split, 'item', item_id, user_id FROM t) {segments_sql('u', 'split, side, id', 'other', 'others')}")
def neighbor_maps(spark, d):
    """Neighbours of users and items in the graphs with and without support, in segments of 16."""
    t = stored(splits.split_tables(pairs(spark, d), "item_id", 30).where(F.col("split").startswith("warm_train")))
    side = lambda name, a, b: t.select("split", F.lit(name).alias("side"), F.col(a).alias("id"), F.col(b).alias("other"))
    return segments(side("user", "user_id", "item_id").union(side("item", "item_id", "user_id")), "other", "split", "side", "id", size=16, name="others")


# Examples for tuning.

_LISTED = "it AS (SELECT DISTINCT p_partkey AS item_id FROM part), top AS (SELECT max(item_id) + 1 AS top, count(*) AS n FROM it)"


def _unmet_sql(who: str = "SELECT DISTINCT user_id FROM ix", met: str = "ix", group: str = "'_all'") -> str:
    """SQL of the unmet items by rank: un (user_id, g, item_id, x, open); ``who`` lists the users that are asked for."""
    return f"""un AS MATERIALIZED (SELECT w.user_id, {group} AS g, it.item_id, row_number() OVER (PARTITION BY w.user_id, {group} ORDER BY it.item_id) - 1 AS x, count(*) OVER (PARTITION BY w.user_id, {group}) AS open FROM ({who}) w, it WHERE NOT EXISTS (SELECT 1 FROM {met} kn WHERE kn.user_id = w.user_id AND kn.item_id = it.item_id))"""


def _drawn_sql(source: str, ratio: int = 1) -> str:
    """SQL of ``drawn_negatives``: ng (user_id, item_id)."""
    return f"""{_LISTED}, us AS (SELECT user_id, count(*) * {ratio} AS need FROM {source} GROUP BY 1), un AS MATERIALIZED (SELECT us.user_id, need, it.item_id, row_number() OVER (PARTITION BY us.user_id ORDER BY it.item_id) - 1 AS x, count(*) OVER (PARTITION BY us.user_id) AS open FROM us, it WHERE NOT EXISTS (SELECT 1 FROM {source} kn WHERE kn.user_id = us.user_id AND kn.item_id = it.item_id)),
dr AS (SELECT user_id, open, unnest(range(least(need, open))) AS k, least(need, open) AS n FROM (SELECT DISTINCT user_id, need, open FROM un)), dx AS (SELECT user_id, k * open // n + {h("user_id || '-' || k", 'd')} % ((k + 1) * open // n - k * open // n) AS x FROM dr), ng AS (SELECT un.user_id, item_id FROM dx JOIN un USING (user_id, x))"""


@query(f"WITH {IX}, {_drawn_sql('ix')} SELECT user_id, item_id, 1 AS label, round(0.6 + ({h(_K, 'l')} % 41) / 100.0::DOUBLE, 2) AS soft FROM ix UNION ALL SELECT user_id, item_id, 0, round(({h(_K, 'l')} % 41) / 100.0::DOUBLE, 2) FROM ng")
def sft_all_negatives(spark, d):
    """All positives, and for each user as many unmet items, or all unmet ones; noisy labels of two decimals."""
    ix = pairs(spark, d)
    neg = drawn_negatives(ix, table(spark, d, "part").select(F.col("p_partkey").alias("item_id")).distinct())
    noise = (hash_order(F.concat_ws("-", "user_id", "item_id"), "l") % 41) / 100.0
    return ix.select("user_id", "item_id", F.lit(1).alias("label"), F.round(0.6 + noise, 2).alias("soft")).union(neg.select("user_id", "item_id", F.lit(0), F.round(noise, 2)))


_PROFILE = "'A ' || lower(c_mktsegment) || ' customer from ' || n_name"


@query(f"WITH {IX}, tr AS (SELECT user_id, item_id FROM ix WHERE {h('user_id', 'u')} % 4 <> 0), {_drawn_sql('tr', 2)}, x AS (SELECT user_id, item_id, 1 AS label FROM tr UNION ALL SELECT user_id, item_id, 0 FROM ng) SELECT user_id, item_id, label, {_PROFILE} || '. Would they buy ' || p_name || '?' AS input FROM x JOIN customer ON c_custkey = user_id JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = item_id")
def sft_user_profiles(spark, d):
    """Warm users' positives and twice as many negatives, in prompts that give a profile in place of a history."""
    train = pairs(spark, d).where(hash_order(F.col("user_id"), "u") % 4 != 0)
    neg = drawn_negatives(train, table(spark, d, "part").select(F.col("p_partkey").alias("item_id")).distinct(), 2)
    rows = train.select("user_id", "item_id", F.lit(1).alias("label")).union(neg.select("user_id", "item_id", F.lit(0)))
    users = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("A "), F.lower("c_mktsegment"), F.lit(" customer from "), "n_name").alias("profile"))
    both = rows.join(users, "user_id").join(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name"), "item_id")
    return both.select("user_id", "item_id", "label", text.rendered("{profile}. Would they buy {title}?", profile=F.col("profile"), title=F.col("p_name")).alias("input"))


_HISTORY = f"hs AS (SELECT user_id, item_id, p_name, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS r FROM ix JOIN part ON p_partkey = item_id QUALIFY r <= 10)"


@query(f"""WITH {IX}, {_HISTORY}, {_LISTED}, po AS (SELECT user_id, item_id, 1 AS label FROM (SELECT *, row_number() OVER (ORDER BY {h(_K, 's')}, user_id, item_id) AS r FROM (SELECT user_id, item_id FROM ix)) WHERE r <= 400), us AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS no FROM (SELECT DISTINCT user_id FROM ix)), nj AS (SELECT j, user_id FROM range(1, 401) t(j) JOIN us ON no = {h("'u' || j", 's')} % (SELECT count(*) FROM us)),
{_unmet_sql("SELECT DISTINCT user_id FROM nj")}, ne AS (SELECT j, nj.user_id, item_id FROM nj JOIN un ON un.user_id = nj.user_id AND x = {h("'n' || j", 's')} % open), ex AS (SELECT 0::BIGINT AS j, * FROM po UNION ALL SELECT j, user_id, item_id, 0 FROM ne)
SELECT j, ex.user_id, ex.item_id, label, CASE WHEN {h("j || '-' || ex.user_id || '-' || ex.item_id", 'n')} % 100 < 15 THEN 'No visible history' ELSE coalesce((SELECT string_agg(hs.p_name, ', ' ORDER BY r) FROM hs WHERE hs.user_id = ex.user_id AND hs.item_id <> ex.item_id), 'No visible history') END AS history FROM ex""")
def sft_sampled_histories(spark, d):
    """As many sampled positives as negatives; histories lack the target, and are hidden from 15 of 100."""
    ix = stored(interactions(spark, d).select("user_id", "item_id", "ts"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    w = Window.partitionBy("user_id").orderBy("ts", "item_id")
    lists = ix.join(items, "item_id").withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("r", "item_id", "p_name"))).alias("seen"))
    key = F.concat_ws("-", "user_id", "item_id")
    first = numbered(ix.select("user_id", "item_id", hash_order(key, "s").alias("x")), "x", "user_id", "item_id", name="r").where("r <= 400")
    pos = first.select(F.lit(0).cast("long").alias("j"), "user_id", "item_id", F.lit(1).alias("label"))
    users = stored(numbered(ix.select("user_id").distinct(), "user_id", name="no").withColumn("no", F.col("no") - 1))
    n = users.count()
    asked = spark.range(1, 401).select(F.col("id").alias("j"), (hash_order(F.concat(F.lit("u"), F.col("id").cast("string")), "s") % n).alias("no")).join(users, "no").select("j", "user_id")
    neg = complement.drawn_unmet(asked, ix, items, "user_id", "item_id", hash_order(F.concat(F.lit("n"), F.col("j").cast("string")), "s"))
    rows = pos.union(neg.where("item_id is not null").select("j", "user_id", "item_id", F.lit(0))).join(lists, "user_id", "left")
    shown = F.array_join(F.transform(F.filter("seen", lambda s: s["item_id"] != F.col("item_id")), lambda s: s["p_name"]), ", ")
    hidden = hash_order(F.concat_ws("-", "j", "user_id", "item_id"), "n") % 100 < 15
    return rows.select("j", "user_id", "item_id", "label", F.when(hidden, "No visible history").otherwise(F.coalesce(F.nullif(shown, F.lit("")), F.lit("No visible history"))).alias("history"))


_PROBE = f"""{_WARM}, ho AS (SELECT user_id, item_id, grp FROM ix JOIN grps USING (item_id) WHERE grp <> 'warm'), po AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {h(_K, 'p1')}, user_id, item_id) AS r FROM ho) WHERE r <= 300), us AS (SELECT DISTINCT user_id AS other FROM ix),
un AS MATERIALIZED (SELECT t.item_id, other, row_number() OVER (PARTITION BY t.item_id ORDER BY other) - 1 AS x, count(*) OVER (PARTITION BY t.item_id) AS open FROM (SELECT DISTINCT item_id FROM po) t, us WHERE NOT EXISTS (SELECT 1 FROM ix WHERE ix.user_id = other AND ix.item_id = t.item_id)), ne AS (SELECT po.item_id, grp, other FROM po JOIN un ON un.item_id = po.item_id AND x = {h(_K.replace("item_id", "po.item_id"), 'p2')} % open),
pb AS (SELECT user_id, item_id, grp AS entity_type, 1 AS label FROM po UNION ALL SELECT other, item_id, grp || '_negative', 0 FROM ne)"""


def _probe(spark, d):
    """Up to 300 held-out positives of each group by hash, and for each one user who isn't known to have met the item."""
    from frostline.plans.base import grouped_pairs

    ix = grouped_pairs(spark, d)
    key = F.concat_ws("-", "user_id", "item_id")
    placed = numbered(ix.where("grp <> 'warm'").withColumn("x", hash_order(key, "p1")), "grp", "x", "user_id", "item_id", name="g")
    first = placed.groupBy("grp").agg(F.min("g").alias("g0"))  # two groups
    pos = stored(placed.join(F.broadcast(first), "grp").where("g - g0 < 300").select("user_id", "item_id", "grp"))
    met = ix.select(F.col("user_id").alias("other"), "item_id")
    fresh = complement.drawn_unmet(pos, met, met.select("other").distinct(), "item_id", "other", hash_order(key, "p2")).where("other is not null")
    return pos.select("user_id", "item_id", F.col("grp").alias("entity_type"), F.lit(1).alias("label")).union(fresh.select("other", "item_id", F.concat("grp", F.lit("_negative")), F.lit(0)))


@query(f"WITH {_PROBE} SELECT user_id, item_id, entity_type, label, 'User id: \"' || user_id || '\". Target product: \"' || p_name || '\".' AS input FROM pb JOIN part ON p_partkey = item_id")
def no_context_probe(spark, d):
    """Examples without any history, held-out pairs beside unknown ones."""
    rows = _probe(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_name"), "item_id")
    return rows.select("user_id", "item_id", "entity_type", "label", text.rendered('User id: "{user}". Target product: "{title}".', user=F.col("user_id"), title=F.col("p_name")).alias("input"))


@query(f"WITH {_PROBE}, s AS (SELECT label, CAST({h(_K, 'p3')} % 101 AS DOUBLE) / 100 + label * 0.1::DOUBLE AS score FROM pb), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mr FROM s) SELECT count(*) AS examples, round(avg(score) FILTER (WHERE label = 1), 6) AS positive_mean, round(avg(score) FILTER (WHERE label = 0), 6) AS negative_mean, round((sum(mr * label) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r")
def probe_summary(spark, d):
    """Mean scores of a probe's two sides (of a stand-in scorer) and the area under their curve."""
    score = (hash_order(F.concat_ws("-", "user_id", "item_id"), "p3") % 101).cast("double") / 100 + F.col("label") * F.lit(0.1)
    s = stored(_probe(spark, d).select("label", score.alias("score")))
    means = s.agg(F.count("*").alias("examples"), F.round(F.avg(F.when(F.col("label") == 1, F.col("score"))), 6).alias("positive_mean"), F.round(F.avg(F.when(F.col("label") == 0, F.col("score"))), 6).alias("negative_mean"))
    return means.join(evaluate.auc(s).select("auc"), F.lit(True))


# Graph and factors.


@query(f"""WITH {_NORM}, n AS (SELECT count(*) AS n FROM embeddings), e0 AS (SELECT 'u' AS side, user_id AS id, pos, embedding[pos]::DOUBLE AS x FROM (SELECT DISTINCT user_id FROM nm), n, embeddings, range(1, 65) t(pos) WHERE vec_id = (user_id * 7 + 3) % n UNION ALL SELECT 'i', item_id, pos, embedding[pos]::DOUBLE FROM (SELECT DISTINCT item_id FROM nm), n, embeddings, range(1, 65) t(pos) WHERE vec_id = item_id % n),
e1 AS (SELECT 'i' AS side, item_id AS id, pos, sum(w * x) AS x FROM nm JOIN e0 ON side = 'u' AND id = user_id GROUP BY 2, 3 UNION ALL SELECT 'u', user_id, pos, sum(w * x) FROM nm JOIN e0 ON side = 'i' AND id = item_id GROUP BY 2, 3), e2 AS (SELECT 'i' AS side, item_id AS id, pos, sum(w * x) AS x FROM nm JOIN e1 ON side = 'u' AND id = user_id GROUP BY 2, 3 UNION ALL SELECT 'u', user_id, pos, sum(w * x) FROM nm JOIN e1 ON side = 'i' AND id = item_id GROUP BY 2, 3)
SELECT side, id, pos, round(sum(x) / 3, 6) AS x FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY 1, 2, 3""")
def propagate_two_layers(spark, d):
    """Mean of whole vectors before, after one and after two steps over the graph."""
    edges, nodes = _graph(spark, d)
    found = factors.propagated(edges, nodes, 2)
    return found.select("side", "id", F.posexplode("v").alias("k", "x")).select("side", "id", (F.col("k") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


def _graph(spark, d):
    edges = stored(graph.symmetric_normalised(_edges(spark, d)))
    v = vectors(spark, d)
    n = v.count()
    nodes = edges.select(F.lit("u").alias("side"), F.col("user_id").alias("id"), ((F.col("user_id") * 7 + 3) % n).alias("vec_id")).union(edges.select(F.lit("i"), "item_id", F.col("item_id") % n)).distinct()
    return edges, stored(nodes.join(v, "vec_id").select("side", "id", "v"))


@query(f"WITH {_NORM} SELECT user_id, item_id, round(w / 0.8::DOUBLE, 6) AS w FROM nm WHERE {h(_K, 'dr')} % 100 < 80")
def edge_dropout(spark, d):
    """Four fifths of the edges, by hash, weighed up for the rest."""
    return graph.kept_edges(graph.symmetric_normalised(_edges(spark, d)), 0.8, "dr").withColumn("w", F.round("w", 6))


def _triples_sql(seed) -> str:
    """SQL of drawn users and positives: po (j, user_id, positive)."""
    return f"""us AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS no, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM ix)), pl AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM ix), dw AS (SELECT j, us.user_id FROM range(0, 5000) t(j) JOIN us ON no = {h("'u' || j", seed)} % n), po AS (SELECT j, dw.user_id, item_id AS positive FROM dw JOIN pl ON pl.user_id = dw.user_id AND place = {h("'p' || j", seed)} % n)"""


@query(f"WITH {IX}, {_LISTED}, {_triples_sql(3)}, {_unmet_sql()} SELECT j, po.user_id, positive, item_id AS negative FROM po JOIN un ON un.user_id = po.user_id AND x = {h("'n' || j", 3)} % open")
def sampled_triples(spark, d):
    """Users drawn with replacement, a positive and an unmet item of each, drawn by rank among all unmet ones."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id")).distinct()
    return complement.negative_triples(pairs(spark, d), items, 5000, 3).drop("mode")


_GROUPED = "it AS (SELECT p_partkey AS item_id, coalesce(grp, 'none') AS grp FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN grps ON item_id = p_partkey)"


@query(f"""WITH {GROUPS}, {_GROUPED}, {_triples_sql(4)}, {_unmet_sql(group="grp")}, ua AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS x, count(*) OVER (PARTITION BY user_id) AS open FROM un), pg AS (SELECT po.*, coalesce(grp, 'none') AS g FROM po LEFT JOIN grps ON item_id = positive),
sg AS (SELECT j, pg.user_id, positive, item_id AS negative FROM pg JOIN un ON un.user_id = pg.user_id AND un.g = pg.g AND x = {h("'n' || j", 4)} % open) SELECT *, 'same_group' AS mode FROM sg UNION ALL SELECT j, pg.user_id, positive, item_id, 'uniform' FROM pg JOIN ua ON ua.user_id = pg.user_id AND x = {h("'n' || j", 4)} % open WHERE j NOT IN (SELECT j FROM sg)""")
def group_triples(spark, d):
    """Negatives of the positive's own group; of all unmet items where the user has met the whole group."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    return complement.negative_triples(pairs(spark, d), items, 5000, 4, ("same_group", "uniform"), item_groups(spark, d))


_POOL = "pool AS (SELECT a.user_id, b.item_id, row_number() OVER (PARTITION BY a.user_id ORDER BY b.user_id, b.ts, b.item_id) AS place FROM (SELECT DISTINCT user_id FROM ix) a JOIN ix b ON b.user_id IN (a.user_id + 1, a.user_id + 2) AND a.user_id % 4 <> 0)"


@query(f"""WITH {GROUPS}, {_GROUPED}, {_triples_sql(5)}, {_unmet_sql(group="grp")}, {_POOL}, pf AS (SELECT user_id, item_id, grp, min(place) AS place FROM pool JOIN grps USING (item_id) GROUP BY ALL), ph AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY place, item_id) AS r FROM pf QUALIFY r <= 8), pu AS (SELECT user_id, grp AS g, item_id, row_number() OVER (PARTITION BY user_id, grp ORDER BY place, item_id) - 1 AS x, count(*) OVER (PARTITION BY user_id, grp) AS open FROM ph ANTI JOIN ix USING (user_id, item_id)),
ua AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS x, count(*) OVER (PARTITION BY user_id) AS open FROM un), pg AS (SELECT po.*, coalesce(grp, 'none') AS g, {h("'n' || j", 5)} AS draw FROM po LEFT JOIN grps ON item_id = positive), hd AS (SELECT j, pg.user_id, positive, item_id AS negative FROM pg JOIN pu ON pu.user_id = pg.user_id AND pu.g = pg.g AND x = draw % open),
sg AS (SELECT j, pg.user_id, positive, item_id AS negative FROM pg JOIN un ON un.user_id = pg.user_id AND un.g = pg.g AND x = draw % open WHERE j NOT IN (SELECT j FROM hd)) SELECT *, 'hard' AS mode FROM hd UNION ALL SELECT *, 'same_group' FROM sg UNION ALL SELECT j, pg.user_id, positive, item_id, 'uniform' FROM pg JOIN ua ON ua.user_id = pg.user_id AND x = draw % open WHERE j NOT IN (SELECT j FROM hd) AND j NOT IN (SELECT j FROM sg)""")
def hard_triples(spark, d):
    """Negatives from the first eight of a ranked pool of the positive's group (what the next two users have met,
    for three users of four), else of its group, else of all unmet items."""
    ix = stored(interactions(spark, d))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))
    near = ix.select(F.explode(F.array(F.col("user_id") - 1, F.col("user_id") - 2)).alias("to"), F.col("user_id").alias("from"), "ts", "item_id")
    asked = ix.where("user_id % 4 <> 0").select(F.col("user_id").alias("to")).distinct()
    w = Window.partitionBy("to").orderBy("from", "ts", "item_id")
    pools = near.join(asked, "to").select(F.col("to").alias("user_id"), "item_id", F.row_number().over(w).alias("place"))
    return complement.negative_triples(ix, items, 5000, 5, ("hard", "same_group", "uniform"), item_groups(spark, d), pools, 8)


@query()
def mf_scores(spark, d):
    """Matrix factorisation by pairwise loss: each user's 20 best unmet items."""
    return _recommended(spark, d, 0)


@query()
def graph_scores(spark, d):
    """The same over vectors that two steps over the graph have mixed."""
    return _recommended(spark, d, 2, epochs=1, steps=2)


def _recommended(spark, d, layers, **parameters):
    from frostline.operators import candidates as C

    p = stored(pairs(spark, d))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id")).distinct()
    out = factors.trained(p, items, **{"dim": 16, "epochs": 2, "layers": layers} | parameters)
    side = lambda s: out.where(F.col("side") == s).select("id", "v")
    top = C.top_candidates(side("u"), side("i"), p.select(F.col("user_id").alias("target"), F.col("item_id").alias("entity")), 20)
    return top.select(F.col("target").alias("user_id"), F.col("entity").alias("item_id"), F.col("candidate_rank").alias("rank"), "score")


@query()
def two_tower_head(spark, d):
    """A head of two towers learned from soft labels: loss and accuracy of each epoch on held-out pairs; the best is marked."""
    from frostline.plans.base import user_vectors

    # Most items have no vector, so their pairs go before any vector is sent; the towers take floats.
    floats = lambda df, side, name: df.select(F.col("id").alias(side), F.col("v").cast("array<float>").alias(name))
    items = floats(vectors(spark, d).withColumnRenamed("vec_id", "id"), "item_id", "i")
    sp = stored(scored_pairs(spark, d).join(items.select("item_id"), "item_id", "left_semi").select("user_id", "item_id", "llm"))
    rows = sp.join(floats(user_vectors(spark, d, sp), "user_id", "u"), "user_id").join(items, "item_id")
    share = hash_uniform(F.concat_ws("-", "user_id", "item_id"), "tt")
    _, report = towers.train(rows.select("u", "i", F.col("llm").alias("label"), share.alias("share")))
    return spark.createDataFrame(report, "epoch int, loss double, accuracy double, best boolean")


@query("""WITH t AS (SELECT p_partkey AS item_id, unnest([x FOR x IN regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}_]+') IF length(x) >= 2]) AS term FROM part), b AS (SELECT item_id, """ + h("term", "v") + """ % 16 AS pos, CAST(sum(CASE WHEN """ + h("term", "w") + """ % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM t GROUP BY 1, 2) SELECT item_id, pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 1e-12), 6) AS x FROM b WHERE x <> 0""")
def hashed_vectors(spark, d):
    """Text vectors of the default embedder: words hashed to signed components, of unit length."""
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    v = models.embedded(docs, models.hashed_words(16))
    return v.select(F.col("id").alias("item_id"), F.posexplode("v").alias("pos", "x")).where("x <> 0").select("item_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


_TOKENS = f"tk AS (SELECT vec_id % 12 AS id, vec_id // 12 AS pos, CASE WHEN {h('vec_id', 'm')} % 5 = 0 THEN 0 ELSE 1 END AS mask, embedding::DOUBLE[] AS v FROM embeddings), tu AS (SELECT * FROM tk WHERE pos < 32)"


@query(f"WITH {_TOKENS}, al AS (SELECT id, pos, mask, v, max(CASE WHEN mask = 1 THEN pos END) OVER (PARTITION BY id) AS last FROM tu) SELECT id, 'mean' AS mode, k AS pos, round(sum(v[k] * mask) / greatest(sum(mask), 1), 6) AS x FROM tu, range(1, 65) t(k) GROUP BY 1, 3 UNION ALL SELECT id, 'last', k, round(v[k], 6) FROM al, range(1, 65) t(k) WHERE pos = last")
def pooled_vectors(spark, d):
    """Token vectors (every twelfth row is of one text) pooled to one a text: masked means and last unmasked tokens of 32 positions."""
    v = vectors(spark, d)
    tokens = v.select((F.col("vec_id") % 12).alias("id"), F.expr("vec_id div 12").alias("pos"), F.when(hash_order(F.col("vec_id"), "m") % 5 == 0, 0).otherwise(1).alias("mask"), "v")
    out = None
    for mode in ("mean", "last"):
        one = models.pooled(tokens, mode, 32).select("id", F.lit(mode).alias("mode"), F.posexplode("v").alias("k", "x")).select("id", "mode", (F.col("k") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))
        out = one if out is None else out.union(one)
    return out


_TERMS = "tt AS (SELECT p_partkey AS id, unnest([x FOR x IN regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}_]+') IF length(x) >= 2]) AS term FROM part), tw AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS weight FROM tt GROUP BY 1, 2)"
_MD5 = "md5('pc:' || term || '-' || k)"
_NORMAL = f"sqrt(-2 * ln((CAST('0x' || substr({_MD5}, 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)) * cos(2 * pi() * CAST('0x' || substr({_MD5}, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE) / sqrt(16.0::DOUBLE)"


@query(f"WITH {_TERMS}, gm AS (SELECT term, k, {_NORMAL} AS r FROM (SELECT DISTINCT term FROM tw), range(0, 16) t(k)), px AS (SELECT id, k, sum(weight * r) AS x FROM tw JOIN gm USING (term) GROUP BY 1, 2) SELECT id AS item_id, k AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM px")
def projected_content(spark, d):
    """Word counts of parts projected on 16 random directions, of unit length."""
    v = models.projected(part_terms(spark, d), 16, "pc")
    return v.select(F.col("id").alias("item_id"), F.posexplode("v").alias("k", "x")).select("item_id", F.col("k").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query()
def tfidf_svd(spark, d):
    """Text vectors by TF-IDF of words and pairs of words, projected on their first singular vectors, of unit length."""
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return models.text_factors(docs, 16)


_WEIGHTS = [0.0, 0.25, 0.5, 0.75, 1.0]
_LIMITS = {"strict_cold": 0.2, "warmup": 0.4, "overall": 0.3}


@query(f"""WITH {SP}, lb AS (SELECT *, CASE WHEN {h(_K, 'z')} % 100 < llm * 60 + emb * 20 THEN 1 ELSE 0 END AS label FROM sp), ca AS (SELECT *, row_number() OVER (PARTITION BY entity_type, user_id ORDER BY emb DESC, item_id) AS ra, row_number() OVER (PARTITION BY entity_type, user_id ORDER BY llm DESC, item_id) AS rb FROM lb QUALIFY ra <= 20 OR rb <= 20),
sc AS (SELECT entity_type, user_id, w, label, row_number() OVER (PARTITION BY entity_type, user_id, w ORDER BY round(w * emb + (1 - w) * llm, 9) DESC, item_id) AS r FROM ca, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w)), hi AS (SELECT entity_type, w, sum(label) AS hits FROM sc WHERE r <= 5 GROUP BY 1, 2), tr AS (SELECT entity_type, sum(label) AS truth FROM lb GROUP BY 1), re AS (SELECT * FROM hi JOIN tr USING (entity_type)),
ch AS (SELECT s.w AS strict_cold_weight, u.w AS warmup_weight, round(s.hits / s.truth, 9) AS strict_cold, round(u.hits / u.truth, 9) AS warmup, round((s.hits + u.hits) / (s.truth + u.truth), 9) AS overall FROM re s, re u WHERE s.entity_type = 'strict_cold' AND u.entity_type = 'warmup'), mg AS (SELECT *, least(round(strict_cold - 0.2::DOUBLE, 9), round(warmup - 0.4::DOUBLE, 9), round(overall - 0.3::DOUBLE, 9)) AS margin, round(strict_cold + warmup + overall, 9) AS total FROM ch)
SELECT strict_cold_weight, warmup_weight, round(strict_cold, 6) AS strict_cold, round(warmup, 6) AS warmup, round(overall, 6) AS overall, round(margin, 6) AS margin, row_number() OVER (ORDER BY margin DESC, total DESC, strict_cold_weight, warmup_weight) = 1 AS chosen FROM mg""")
def scanned_blend(spark, d):
    """Recalls of all choices of two groups' weights between two scores, of which the one with the greatest least margin is chosen."""
    sp = stored(scored_pairs(spark, d))
    label = (hash_order(F.concat_ws("-", "user_id", "item_id"), "z") % 100 < F.col("llm") * 60 + F.col("emb") * 20).cast("int")
    scan = evaluate.blend_scan(sp.select("user_id", "item_id", "entity_type", F.col("emb").alias("a"), F.col("llm").alias("b"), label.alias("label")), _WEIGHTS, 5, 20)
    found = evaluate.blend_choices(scan, _LIMITS)
    return found.select("strict_cold_weight", "warmup_weight", *[F.round(c, 6).alias(c) for c in ("strict_cold", "warmup", "overall", "margin")], "chosen")


_BLEND = "CASE WHEN id % 3 = 0 THEN 0.7::DOUBLE WHEN id % 3 = 1 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END"


@query(f"WITH {SP}, v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT id, v, [x / greatest(sqrt(list_dot_product(v, v)), 1e-12) FOR x IN v] AS n FROM v) SELECT id, pos, round({_BLEND} * v[pos] + (1 - {_BLEND}) * n[pos] * 2, 6) AS x FROM u, range(1, 65) t(pos)")
def blended_checkpoint(spark, d):
    """Two stored sets of vectors blended with a weight by group, stored as a checkpoint and read again."""
    from frostline.functions.vectors import l2_normalised

    v = vectors(spark, d).withColumnRenamed("vec_id", "id")
    weight = F.when(F.col("id") % 3 == 0, 0.7).when(F.col("id") % 3 == 1, 0.5).otherwise(0.2)
    other = v.select("id", F.transform(l2_normalised("v"), lambda x: x * 2).alias("v"))
    kept = stored(factors.blended(v.withColumn("weight", weight), other))
    return kept.select("id", F.posexplode("v").alias("k", "x")).select("id", (F.col("k") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))
