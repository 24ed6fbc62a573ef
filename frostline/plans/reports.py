"""Queries over evaluation by group, simulation quality and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frostline.operators import candidates as C
from frostline.operators import evaluate, splits, stats
from frostline.operators.ids import hash_order
from frostline.plans.base import GROUPS, IX, SP, VECTORS, groups_sql, h, item_groups, item_vectors, pairs, query, scored_pairs, user_vectors
from frostline.sources.storage import stored
from frostline.sources.tables import table

_K = "user_id || '-' || item_id"
_CT = f"{SP}, cd AS (SELECT user_id, item_id, entity_type, row_number() OVER (PARTITION BY user_id, entity_type ORDER BY emb DESC, item_id) AS rank FROM sp QUALIFY rank <= 10), tr AS (SELECT user_id, item_id, entity_type FROM sp WHERE llm >= 0.8)"


def _lists(spark, d):
    """The ten best of each user and entity type by embedding, and truth."""
    sp = scored_pairs(spark, d)
    w = Window.partitionBy("user_id", "entity_type").orderBy(F.col("emb").desc(), "item_id")
    cd = sp.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("user_id", "item_id", "entity_type", "rank")
    return cd, sp.where("llm >= 0.8").select("user_id", "item_id", "entity_type")


_HC = f"{_CT}, u AS (SELECT tr.entity_type, tr.user_id, count(*) AS n, count(cd.item_id) AS h FROM tr LEFT JOIN cd USING (entity_type, user_id, item_id) GROUP BY 1, 2), hc AS (SELECT entity_type, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (WHERE h > 0) AS users_hit, count(*) AS users FROM u GROUP BY 1)"


@query(f"WITH {_HC} SELECT * FROM hc")
def hit_counters(spark, d):
    return evaluate.hit_counters(*_lists(spark, d))


@query(f"WITH {_HC} SELECT round(avg(hits::DOUBLE / total), 6) AS macro, round(sum(hits)::DOUBLE / sum(total), 6) AS pooled FROM hc")
def macro_recall(spark, d):
    return evaluate.macro_recall(evaluate.hit_counters(*_lists(spark, d)))


_IDEAL = "ideal AS (SELECT k, sum(1 / log2(x + 1.0::DOUBLE)) AS g FROM range(1, 21) a(k), range(1, 21) b(x) WHERE x <= k GROUP BY 1)"


def _report_sql(ctes: str, k: int) -> str:
    """Per entity_type of rk (user_id, item_id, entity_type, rank) and tt (user_id, item_id, entity_type)."""
    return f"""{ctes}, {_IDEAL}, top AS (SELECT * FROM rk WHERE rank <= {k}), hh AS (SELECT entity_type, user_id, count(*) AS h, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM top JOIN tt USING (entity_type, user_id, item_id) GROUP BY 1, 2), cv AS (SELECT DISTINCT entity_type, user_id, 1 AS c FROM top),
us AS (SELECT entity_type, user_id, count(*) AS n FROM tt GROUP BY 1, 2) SELECT entity_type, count(*) AS users, count(c) AS covered, CAST(sum(coalesce(h, 0)) AS BIGINT) AS hits, round(avg(coalesce(h, 0)::DOUBLE / n), 6) AS recall, round(avg(coalesce(h, 0) / {k}.0::DOUBLE), 6) AS precision, round(avg(coalesce(dcg, 0) / g), 6) AS ndcg FROM us LEFT JOIN hh USING (entity_type, user_id) LEFT JOIN cv USING (entity_type, user_id) JOIN ideal ON k = least(n, {k}) GROUP BY 1"""


@query(f"WITH {_report_sql(_CT + ', rk AS (SELECT * FROM cd UNION ALL SELECT user_id, item_id, $$union$$, row_number() OVER (PARTITION BY user_id ORDER BY rank, entity_type, item_id) FROM cd), tt AS (SELECT * FROM tr UNION ALL SELECT user_id, item_id, $$union$$ FROM tr)', 10)}")
def candidate_report(spark, d):
    """Candidate lists of two entity types and of both together: coverage and ranking metrics."""
    cd, tr = _lists(spark, d)
    both = cd.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("rank", "entity_type", "item_id"))).withColumn("entity_type", F.lit("union"))
    return evaluate.report_by_group(cd.union(both), tr.union(tr.withColumn("entity_type", F.lit("union"))), 10)


_HV = " UNION ALL ".join(
    f"SELECT '{rows}_{typed}_{side}' AS variant, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(h) AS BIGINT) AS hits, count(*) AS entities, count(*) FILTER (WHERE h > 0) AS entities_hit FROM (SELECT t.{side}_id, count(*) AS n, count(c.user_id) AS h FROM ({'SELECT * FROM tw' if rows == 'rows' else 'SELECT DISTINCT user_id, item_id' + (', entity_type' if typed == 'typed' else '') + ' FROM tw'}) t LEFT JOIN (SELECT DISTINCT user_id, item_id{', entity_type' if typed == 'typed' else ''} FROM cd) c USING (user_id, item_id{', entity_type' if typed == 'typed' else ''}) GROUP BY 1)"
    for rows in ("rows", "pairs") for typed in ("typed", "untyped") for side in ("item", "user")
)


@query(f"WITH {_CT}, tw AS (SELECT * FROM tr UNION ALL SELECT * FROM tr WHERE item_id % 5 = 0 UNION ALL SELECT user_id, item_id, 'warm' FROM tr WHERE item_id % 7 = 0) {_HV}")
def hit_variants(spark, d):
    """Hits counted by rows or by distinct pairs, with or without the entity type, by item and by user."""
    cd, tr = _lists(spark, d)
    truth, cd = stored(tr.union(tr.where("item_id % 5 = 0")).union(tr.where("item_id % 7 = 0").withColumn("entity_type", F.lit("warm")))), stored(cd)
    out = None
    for rows in ("rows", "pairs"):
        for typed, keys in (("typed", ["user_id", "item_id", "entity_type"]), ("untyped", ["user_id", "item_id"])):
            t = truth if rows == "rows" else truth.select(*keys).distinct()
            found = t.join(cd.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
            for side in ("item", "user"):
                e = found.groupBy(f"{side}_id").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
                one = e.agg(F.sum("n").alias("pairs"), F.sum("h").alias("hits"), F.count("*").alias("entities"), F.sum((F.col("h") > 0).cast("long")).alias("entities_hit")).select(F.lit(f"{rows}_{typed}_{side}").alias("variant"), "*")
                out = one if out is None else out.union(one)
    return out


@query(f"WITH {_CT}, f AS (SELECT user_id, min(rank) AS rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank, entity_type, item_id) AS rank FROM cd) JOIN (SELECT DISTINCT user_id, item_id FROM tr) USING (user_id, item_id) GROUP BY 1) SELECT count(*) AS users, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM (SELECT DISTINCT user_id FROM tr) LEFT JOIN f USING (user_id)")
def mean_reciprocal_rank(spark, d):
    cd, tr = _lists(spark, d)
    ranked = cd.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("rank", "entity_type", "item_id")))
    return evaluate.reciprocal_rank(ranked, tr.select("user_id", "item_id"))


def _quality_sql(by: str, other: str, missing: float) -> str:
    t = f"CASE WHEN {h(by, 't')} % 3 = 0 THEN 'warmup' ELSE 'strict_cold' END"
    bin_ = lambda x: f"CAST(least(floor({x} * 10), 9) AS INTEGER)"
    return f"""WITH {SP}, pr AS (SELECT user_id, item_id, {t} AS entity_type, least(greatest(coalesce(CASE WHEN llm >= 0.02 THEN llm END, {missing}::DOUBLE), 0), 1) AS score, CASE WHEN {h(_K, 'q1')} % 100 < llm * 60 THEN 1 ELSE 0 END AS label, CASE WHEN {h(_K, 'q2')} % 100 < llm * 70 THEN 1 ELSE 0 END AS val FROM sp),
hc AS (SELECT {other}, count(*) AS n FROM ix GROUP BY 1), hd AS (SELECT {other} FROM hc WHERE n >= (SELECT quantile_cont(n, 0.8) FROM hc)), g AS (SELECT {by}, sum(label) AS g FROM pr GROUP BY 1 HAVING sum(label) > 0),
tp AS (SELECT *, row_number() OVER (PARTITION BY entity_type, {by} ORDER BY score DESC, {other}) AS r FROM pr QUALIFY r <= 5), ea AS (SELECT entity_type, {by}, count(*) AS n, sum(label) AS h, count(*) FILTER (WHERE {other} IN (SELECT {other} FROM hd)) AS heads FROM tp GROUP BY 1, 2),
rk AS (SELECT entity_type, count(*) AS targets, round(avg(h::DOUBLE / n), 6) AS precision, round(avg(h::DOUBLE / g), 6) AS recall, round(avg(heads::DOUBLE / n), 6) AS head FROM ea JOIN g USING ({by}) GROUP BY 1),
au AS (SELECT entity_type, round((sum(mr * label) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY entity_type ORDER BY score) + (count(*) OVER (PARTITION BY entity_type, score) - 1) / 2.0::DOUBLE AS mr FROM pr) GROUP BY 1),
ra AS (SELECT *, avg(val) OVER (PARTITION BY entity_type, {bin_('score')}) AS rate FROM pr),
e1 AS (SELECT entity_type, round(sum(q) / sum(n), 6) AS brier, round(sum(abs(s - p)) / sum(n), 6) AS ece FROM (SELECT entity_type, {bin_('score')} AS b, count(*) AS n, sum(score) AS s, sum(label) AS p, sum((score - label) * (score - label)) AS q FROM ra GROUP BY 1, 2) GROUP BY 1),
e2 AS (SELECT entity_type, round(sum(q) / sum(n), 6) AS cal_brier, round(sum(abs(s - p)) / sum(n), 6) AS cal_ece FROM (SELECT entity_type, {bin_('rate')} AS b, count(*) AS n, sum(rate) AS s, sum(label) AS p, sum((rate - label) * (rate - label)) AS q FROM ra GROUP BY 1, 2) GROUP BY 1),
ct AS (SELECT entity_type, count(*) AS scored_pairs, CAST(sum(label) AS BIGINT) AS positive_pairs FROM pr GROUP BY 1)
SELECT * FROM ct JOIN rk USING (entity_type) JOIN au USING (entity_type) JOIN e1 USING (entity_type) JOIN e2 USING (entity_type)"""


def _quality(spark, d, by, missing):
    other = "item_id" if by == "user_id" else "user_id"
    sp = scored_pairs(spark, d).withColumn("entity_type", F.when(hash_order(F.col(by), "t") % 3 == 0, "warmup").otherwise("strict_cold"))
    key = F.concat_ws("-", "user_id", "item_id")
    rows = stored(sp.select("user_id", "item_id", "entity_type", "llm", (hash_order(key, "q1") % 100 < F.col("llm") * 60).alias("t"), (hash_order(key, "q2") % 100 < F.col("llm") * 70).alias("v")))
    scored = rows.select("user_id", "item_id", "entity_type", F.when(F.col("llm") >= 0.02, F.col("llm")).alias("probability"))
    return evaluate.simulation_quality(scored, rows.where("t"), rows.where("v"), evaluate.head_entities(pairs(spark, d), other), by, 5, missing)


@query(_quality_sql("item_id", "user_id", 1.0))
def simulation_quality_item(spark, d):
    """How well scores tell the users of items: a score that is missing counts as 1."""
    return _quality(spark, d, "item_id", 1.0)


@query(_quality_sql("user_id", "item_id", 0.0))
def simulation_quality_user(spark, d):
    """How well scores tell the items of users: a score that is missing counts as 0."""
    return _quality(spark, d, "user_id", 0.0)


_FW = f"""{VECTORS}, te AS (SELECT user_id, item_id, grp FROM ix JOIN grps USING ({{by}}) WHERE {h(_K, 'w')} % 5 = 0), tn AS (SELECT user_id, item_id FROM ix JOIN grps USING ({{by}}) WHERE {h(_K, 'w')} % 5 <> 0 AND grp <> 'strict_cold'), pt AS (SELECT unnest(['warm', 'warmup', 'strict_cold', 'overall']) AS part)"""
_DOT = "round(list_dot_product(i.v, u.v), 9)"


def _four(spark, d, groups, by):
    rows = stored(pairs(spark, d).join(groups.select(by, "grp"), by).withColumn("test", hash_order(F.concat_ws("-", "user_id", "item_id"), "w") % 5 == 0).select("user_id", "item_id", "grp", "test"))
    train = rows.where("not test and grp <> 'strict_cold'").select("user_id", "item_id")
    truth = rows.where("test").select("user_id", "item_id", F.col("grp").alias("entity_type"))
    return train, truth.union(truth.withColumn("entity_type", F.lit("overall")))


def _searched(users, items, train):
    seen = train.select(F.col("user_id").alias("target"), F.col("item_id").alias("entity"))
    return C.top_candidates(users, items, seen, 20)


def _listed(top, part):
    return top.select(F.col("target").alias("user_id"), F.col("entity").alias("item_id"), part.alias("entity_type"), F.col("candidate_rank").alias("rank"))


def _overall(tops):
    """Users' best of all items from their best of parts that hold each item once."""
    return _listed(C.ranked(tops.select("target", "entity", "score"), 20, "target"), F.lit("overall"))


@query("WITH " + _report_sql(f"{GROUPS}, {_FW.format(by='item_id')}, rk AS (SELECT u.id AS user_id, i.id AS item_id, part AS entity_type, row_number() OVER (PARTITION BY part, u.id ORDER BY {_DOT} DESC, i.id) AS rank FROM pt, uv u, (SELECT iv.*, grp FROM iv JOIN grps ON id = item_id) i WHERE (part = 'overall' OR grp = part) AND NOT EXISTS (SELECT 1 FROM tn WHERE tn.user_id = u.id AND tn.item_id = i.id) QUALIFY rank <= 20), tt AS (SELECT user_id, item_id, part AS entity_type FROM te, pt WHERE part = 'overall' OR grp = part)", 20))
def eval_four_way(spark, d):
    """Warm, warm-up, strict cold and all items: each part ranks its own group's items, the last all."""
    groups = stored(item_groups(spark, d))
    train, truth = _four(spark, d, groups, "item_id")
    items, users = stored(item_vectors(spark, d).join(groups.select(F.col("item_id").alias("id"), "grp"), "id")), stored(user_vectors(spark, d))
    out = None
    for part in ("warm", "warmup", "strict_cold"):
        one = _searched(users, items.where(F.col("grp") == part).select("id", "v"), train).withColumn("part", F.lit(part))
        out = one if out is None else out.union(one)
    out = stored(out)
    return evaluate.report_by_group(_listed(out, F.col("part")).union(_overall(out)), truth, 20)


@query("WITH " + _report_sql(f"{IX}, {groups_sql('user_id', 40)}, {_FW.format(by='user_id')}, rk AS (SELECT u.id AS user_id, i.id AS item_id, part AS entity_type, row_number() OVER (PARTITION BY part, u.id ORDER BY {_DOT} DESC, i.id) AS rank FROM pt, (SELECT uv.*, grp FROM uv JOIN grps ON id = user_id) u, iv i WHERE (part = 'overall' OR (grp = part AND i.id IN (SELECT item_id FROM tn))) AND NOT EXISTS (SELECT 1 FROM tn WHERE tn.user_id = u.id AND tn.item_id = i.id) QUALIFY rank <= 20), tt AS (SELECT user_id, item_id, part AS entity_type FROM te, pt WHERE part = 'overall' OR grp = part)", 20))
def topk_eval_user_cold(spark, d):
    """Groups of users: items that training lacks are hidden from the three parts, not from all together."""
    groups = stored(splits.entity_groups(pairs(spark, d), "user_id", k0=40))
    train, truth = _four(spark, d, groups, "user_id")
    users, items = stored(user_vectors(spark, d).join(groups.select(F.col("user_id").alias("id"), "grp"), "id")), stored(item_vectors(spark, d))
    met = train.select(F.col("item_id").alias("id")).distinct()
    seen, other = stored(items.join(met, "id", "left_semi")), stored(items.join(met, "id", "left_anti"))
    top = stored(_searched(users.select("id", "v"), seen, train))
    parts = _listed(top.join(users.select(F.col("id").alias("target"), "grp"), "target"), F.col("grp"))
    return evaluate.report_by_group(parts.union(_overall(top.union(_searched(users.select("id", "v"), other, train)))), truth, 20)


# Runs: return flags as methods, line numbers as seeds, odd and even parts as splits.

_RUNS = "rr AS (SELECT l_returnflag AS method, CASE WHEN l_partkey % 2 = 0 THEN 'strict_cold' ELSE 'warmup' END AS split, CAST(l_linenumber AS BIGINT) AS seed, round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice) / 1000, 6) AS price FROM lineitem GROUP BY 1, 2, 3), runs AS (SELECT method, split, 'quantity' AS metric, seed, quantity AS value FROM rr UNION ALL SELECT method, split, 'price', seed, price FROM rr)"


def _runs(spark, d):
    split = F.when(F.col("l_partkey") % 2 == 0, "strict_cold").otherwise("warmup")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), split.alias("split"), F.col("l_linenumber").cast("long").alias("seed"))
    wide = rows.agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_extendedprice") / 1000, 6).alias("price"))
    return wide.unpivot(["method", "split", "seed"], ["quantity", "price"], "metric", "value").select("method", "split", "metric", "seed", "value")


_DECLARED = [("strict_cold", "quantity", "N"), ("strict_cold", "price", "R"), ("warmup", "quantity", "R"), ("warmup", "price", "N")]


@query(f"WITH {_RUNS}, dc AS (SELECT * FROM (VALUES {', '.join(map(str, _DECLARED))}) t(split, metric, comparator)), x AS (SELECT a.split, a.metric, comparator, a.value - b.value AS d FROM runs a JOIN dc USING (split, metric) JOIN runs b ON b.split = a.split AND b.metric = a.metric AND b.seed = a.seed AND b.method = comparator WHERE a.method = 'A'), g AS (SELECT split, metric, comparator, count(*) AS n, avg(d) AS m, stddev_samp(d) AS s FROM x GROUP BY 1, 2, 3), t AS (SELECT *, atan(abs(m / (s / sqrt(n))) / sqrt(n - 1.0)) AS a FROM g) SELECT split, metric, comparator, n, round(m, 6) AS mean_difference, round(1 - sin(a) * (1 + pow(cos(a), 2) / 2 + 3 * pow(cos(a), 4) / 8), 6) AS p_value FROM t")
def comparator_map(spark, d):
    """A method tested against the comparator declared for each cell, over seven seeds."""
    return stats.declared_test(stored(_runs(spark, d)), "A", spark.createDataFrame(_DECLARED, "split string, metric string, comparator string"))


@query(f"WITH {_RUNS}, m AS (SELECT method, split, metric, avg(value) AS v FROM runs GROUP BY 1, 2, 3), b AS (SELECT split, metric, max(v) AS best FROM m WHERE method <> 'A' GROUP BY 1, 2), c AS (SELECT split, metric, v, best FROM m JOIN b USING (split, metric) WHERE method = 'A') SELECT split, metric, round(v / best - 1, 6) AS gain, v >= 0.99 * best AS reaches, bool_and(v >= 0.99 * best) OVER () AS everywhere FROM c")
def all_splits_check(spark, d):
    """Whether a method reaches 99 % of the best other one in every cell."""
    return stats.gains(_runs(spark, d), "A", 0.99)


@query(f"WITH {_RUNS}, o AS (SELECT * FROM runs WHERE method = 'N' AND seed <= 5), w AS (SELECT * FROM runs WHERE method = 'A' AND seed >= 1), m AS (SELECT split, metric, avg(w.value) AS nw FROM w GROUP BY 1, 2), q AS (SELECT split, metric, avg(o.value) AS od FROM o GROUP BY 1, 2), g AS (SELECT split, metric, count(*) AS n, avg(w.value - o.value) AS m, stddev_samp(w.value - o.value) AS s FROM w JOIN o USING (split, metric, seed) GROUP BY 1, 2), t AS (SELECT *, atan(abs(m / (s / sqrt(n))) / 2) AS a FROM g) SELECT split, metric, round(nw - od, 6) AS delta, round((nw - od) / od, 6) AS relative, n, round(1 - sin(a) * (1 + pow(cos(a), 2) / 2), 6) AS p_value FROM m JOIN q USING (split, metric) JOIN t USING (split, metric)")
def run_comparison(spark, d):
    """New runs held against older ones, of which two seeds are missing."""
    runs = _runs(spark, d)
    return stats.compared_runs(runs.where("method = 'N' and seed <= 5"), runs.where("method = 'A'"))


@query(f"WITH {_RUNS}, f AS (SELECT a.method, count(*) AS cells, avg(abs(a.value - b.value)) AS d FROM runs a JOIN runs b USING (split, metric, seed) WHERE b.method = 'A' AND a.method <> 'A' GROUP BY 1) SELECT method, cells, round(d, 6) AS distance, row_number() OVER (ORDER BY d, method) = 1 AS best FROM f")
def method_scan(spark, d):
    """Methods by their distance from a reference's metrics."""
    return stats.nearest_method(_runs(spark, d), "A")


@query(f"WITH {_RUNS}, m AS (SELECT method, seed, round(min(CASE metric WHEN 'quantity' THEN value - 25 ELSE value - 38 END), 9) AS margin, round(sum(CASE metric WHEN 'quantity' THEN value - 25 ELSE value - 38 END), 9) AS total FROM runs GROUP BY 1, 2) SELECT method, seed, round(margin, 6) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY margin DESC, total DESC, seed) AS r FROM m) WHERE r = 1")
def select_best_margin(spark, d):
    """The run of each method whose least margin over two thresholds is greatest."""
    return stats.margin_choice(_runs(spark, d), {"quantity": 25.0, "price": 38.0})


@query(f"WITH {SP}, l AS (SELECT *, {h(_K, 'c')} % 2 AS label FROM sp), k AS (SELECT user_id, item_id, CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END || '_' || side AS kind, row_number() OVER (PARTITION BY label, side ORDER BY CASE side WHEN 'high' THEN -llm ELSE llm END, user_id, item_id) AS place FROM l, (SELECT unnest(['high', 'low']) AS side)) SELECT kind, CAST(place AS INTEGER) AS place, user_id, item_id, c_name || ': ' || p_name AS case_text FROM k JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = item_id WHERE place <= 6")
def case_lists_all(spark, d):
    """The highest and lowest scored pairs of either class, with their text."""
    rows = scored_pairs(spark, d).withColumn("label", hash_order(F.concat_ws("-", "user_id", "item_id"), "c") % 2)
    out = None
    for label, name in ((1, "positive"), (0, "negative")):
        for side, order in (("high", F.col("llm").desc()), ("low", F.col("llm").asc())):
            # The first six of all rows of a class: each task sends six.
            few = rows.where(F.col("label") == label).orderBy(order, "user_id", "item_id").limit(6)
            one = few.select(F.lit(f"{name}_{side}").alias("kind"), F.row_number().over(Window.orderBy(order, "user_id", "item_id")).alias("place"), "user_id", "item_id")
            out = one if out is None else out.union(one)
    named = out.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).join(table(spark, d, "part"), F.col("item_id") == F.col("p_partkey"))
    return named.select("kind", "place", "user_id", "item_id", F.concat("c_name", F.lit(": "), "p_name").alias("case_text"))
