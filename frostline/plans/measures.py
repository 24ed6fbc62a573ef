"""Queries over the graph, evaluation, statistics and learned parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frostline.functions.vectors import dot
from frostline.operators import candidates as C
from frostline.operators import evaluate, graph, models, stats
from frostline.operators.ids import hash_order
from frostline.plans.base import COLD, IX, SP, cold_setting, h, interactions, pairs, query, scored_pairs, vectors
from frostline.plans.retrieval import _LISTS, _observed, rerank_features
from frostline.sources.storage import stored
from frostline.sources.tables import table

_K = "user_id || '-' || item_id"
_EDGE = f"""{SP}, base AS (SELECT user_id, item_id FROM ix WHERE {h(_K, 'g')} % 4 <> 0), ps AS (SELECT user_id, item_id, CASE WHEN llm < 0.05 THEN NULL ELSE llm END AS probability FROM sp WHERE {h(_K, 'g')} % 2 = 0), dg AS (SELECT item_id, count(*) AS d FROM base GROUP BY 1),
ew AS (SELECT user_id, item_id, sum(w) AS w FROM (SELECT user_id, item_id, 1.0::DOUBLE AS w FROM base UNION ALL SELECT user_id, item_id, greatest(0.8::DOUBLE * least(greatest(coalesce(probability, 1.0), 0.0), 1.0) * exp(-0.3::DOUBLE * least(coalesce(d, 0), 5) / 5.0::DOUBLE), 1e-6) FROM ps LEFT JOIN dg USING (item_id)) GROUP BY 1, 2)"""


def _edges(spark, d):
    """Three quarters of the pairs as base, half of all as pseudo-edges: some pairs are both."""
    sp = scored_pairs(spark, d).withColumn("g", hash_order(F.concat_ws("-", "user_id", "item_id"), "g"))
    base = sp.where("g % 4 <> 0").select("user_id", "item_id")
    pseudo = sp.where("g % 2 = 0").select("user_id", "item_id", F.when(F.col("llm") >= 0.05, F.col("llm")).alias("probability"))
    return graph.weighted_edges(base, pseudo, "item_id", 0.8, 0.3)


@query(f"WITH {_EDGE} SELECT user_id, item_id, round(w, 6) AS w FROM ew")
def edge_weights(spark, d):
    return _edges(spark, d).withColumn("w", F.round("w", 6))


_NORM = f"{_EDGE}, nm AS (SELECT user_id, item_id, w / sqrt(sum(w) OVER (PARTITION BY user_id) * sum(w) OVER (PARTITION BY item_id)) AS w FROM ew)"


@query(f"WITH {_NORM} SELECT user_id, item_id, round(w, 6) AS w FROM nm")
def sym_norm(spark, d):
    return graph.symmetric_normalised(_edges(spark, d)).withColumn("w", F.round("w", 6))


@query(f"""WITH {_NORM}, n AS (SELECT count(*) AS n FROM embeddings), e0 AS (SELECT 'u' AS side, user_id AS id, pos, embedding[pos]::DOUBLE AS x FROM (SELECT DISTINCT user_id FROM nm), n, embeddings, range(1, 65) t(pos) WHERE vec_id = (user_id * 7 + 3) % n UNION ALL SELECT 'i', item_id, pos, embedding[pos]::DOUBLE FROM (SELECT DISTINCT item_id FROM nm), n, embeddings, range(1, 65) t(pos) WHERE vec_id = item_id % n),
e1 AS (SELECT 'i' AS side, item_id AS id, pos, sum(w * x) AS x FROM nm JOIN e0 ON side = 'u' AND id = user_id GROUP BY 2, 3 UNION ALL SELECT 'u', user_id, pos, sum(w * x) FROM nm JOIN e0 ON side = 'i' AND id = item_id GROUP BY 2, 3)
SELECT side, id, pos, round(sum(x) / 2, 6) AS x FROM (SELECT * FROM e0 UNION ALL SELECT * FROM e1) GROUP BY 1, 2, 3""")
def propagate_one_layer(spark, d):
    """Mean of whole vectors before and after one step over the graph."""
    from frostline.operators.factors import propagated
    from frostline.plans.training import _graph

    found = propagated(*_graph(spark, d), 1)
    return found.select("side", "id", F.posexplode("v").alias("k", "x")).select("side", "id", (F.col("k") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {IX}, e AS (SELECT user_id, item_id FROM ix WHERE {h(_K, 'v')} % 10 = 0) SELECT user_id, item_id FROM ix EXCEPT SELECT user_id, item_id FROM e")
def exclude_pairs(spark, d):
    """All positives of users less the evaluated split's truth."""
    p = pairs(spark, d)
    truth = p.where(hash_order(F.concat_ws("-", "user_id", "item_id"), "v") % 10 == 0)
    return p.join(truth, ["user_id", "item_id"], "left_anti").select("user_id", "item_id")


_IDEAL = "ideal AS (SELECT k, sum(1 / log2(x + 1.0::DOUBLE)) AS g FROM range(1, 21) a(k), range(1, 21) b(x) WHERE x <= k GROUP BY 1)"


def _metrics_sql(score: str, where: str, ctes: str = "") -> str:
    return f"""WITH {COLD}{ctes}, truth AS (SELECT user_id, item_id FROM ix WHERE item_id IN (SELECT id FROM cold)), s AS (SELECT u.id AS user_id, c.id AS item_id, {score} AS score FROM iv c, uv u WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s),
u AS (SELECT user_id, count(*) AS n FROM truth GROUP BY 1), hh AS (SELECT user_id, count(*) AS h, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM r JOIN truth USING (user_id, item_id) WHERE rank <= 20 GROUP BY 1), {_IDEAL}
SELECT count(*) AS users, CAST(sum(coalesce(h, 0)) AS BIGINT) AS hits, round(avg(coalesce(h, 0)::DOUBLE / n), 6) AS recall, round(avg(coalesce(h, 0) / 20.0::DOUBLE), 6) AS precision, round(avg(coalesce(dcg, 0) / g), 6) AS ndcg FROM u LEFT JOIN hh USING (user_id) JOIN ideal ON k = least(n, 20)"""


def _topk(spark, d, items, hidden=None):
    """Users' 20 best of some items by inner product; ``hidden`` pairs are left out."""
    from frostline.plans.base import user_vectors

    seen = hidden.select(F.col("user_id").alias("target"), F.col("item_id").alias("entity")) if hidden is not None else None
    return _best(C.top_candidates(user_vectors(spark, d), items, seen, 20))


def _best(top):
    return top.select(F.col("target").alias("user_id"), F.col("entity").alias("item_id"), F.col("candidate_rank").alias("rank"))


def _with_prior(spark, d, items, prior):
    """Users' 20 best by inner product plus a prior of some pairs.

    A prior only adds, so a pair without one is among its user's 20 best without priors or isn't among them.
    """
    from frostline.plans.base import user_vectors

    users = user_vectors(spark, d)
    p = prior.select(F.col("user_id").alias("target"), F.col("item_id").alias("entity"), "p")
    known = p.join(users.select(F.col("id").alias("target"), F.col("v").alias("a")), "target").join(items.select(F.col("id").alias("entity"), F.col("v").alias("b")), "entity")
    lifted = known.select("target", "entity", F.round(F.round(dot("a", "b"), 9) + F.col("p"), 9).alias("score"))
    plain = C.top_candidates(users, items, None, 20).select("target", "entity", "score").join(p, ["target", "entity"], "left_anti")
    return _best(C.ranked(plain.union(lifted), 20, "target"))


def _truth(spark, d, cold):
    return pairs(spark, d).join(cold.select(F.col("id").alias("item_id")), "item_id", "left_semi").select("user_id", "item_id")


_DOT = "round(list_dot_product(c.v, u.v), 9)"


@query(_metrics_sql(_DOT, "NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.id AND t.item_id = c.id)"))
def topk_eval_full(spark, d):
    """All items rank, training pairs masked."""
    from frostline.plans.base import item_vectors

    cold, _, train = cold_setting(spark, d)
    return evaluate.ranking_metrics(_topk(spark, d, item_vectors(spark, d), hidden=train), _truth(spark, d, cold), 20)


@query(_metrics_sql(_DOT, "c.id IN (SELECT id FROM cold)"))
def topk_eval_group(spark, d):
    """Only the cold group's items rank."""
    cold, _, _ = cold_setting(spark, d)
    return evaluate.ranking_metrics(_topk(spark, d, cold), _truth(spark, d, cold), 20)


_PRIOR = f", pp AS (SELECT user_id, item_id, max(0.9::DOUBLE * (({h(_K, 'p')} % 101) / 100.0::DOUBLE)) AS p FROM ix GROUP BY 1, 2)"


@query(_metrics_sql(f"round({_DOT} + coalesce((SELECT p FROM pp WHERE pp.user_id = u.id AND pp.item_id = c.id AND p > 0), 0), 9)", "c.id IN (SELECT id FROM cold)", _PRIOR))
def score_prior_eval(spark, d):
    """Scores plus 0.9 times the pairs' probabilities."""
    cold, _, _ = cold_setting(spark, d)
    prior = scored_pairs(spark, d).groupBy("user_id", "item_id").agg(F.max(0.9 * F.col("llm")).alias("p")).where("p > 0")
    return evaluate.ranking_metrics(_with_prior(spark, d, cold, prior), _truth(spark, d, cold), 20)


@query(_metrics_sql(f"round({_DOT} + CASE WHEN c.id IN (SELECT item_id FROM grps WHERE grp = 'warmup') THEN 1.5::DOUBLE ELSE 0 END, 9)", "c.id IN (SELECT id FROM cold)"))
def group_offset_eval(spark, d):
    """A constant is added to the scores of one item group."""
    from frostline.plans.base import item_groups

    cold, users, _ = cold_setting(spark, d)
    lifted = item_groups(spark, d).where("grp = 'warmup'").select(F.col("item_id").alias("id"))
    top = lambda items, offset: C.top_candidates(users, items, None, 20).select("target", "entity", F.round(F.col("score") + offset, 9).alias("score"))
    both = top(cold.join(lifted, "id", "left_semi"), 1.5).union(top(cold.join(lifted, "id", "left_anti"), 0.0))
    return evaluate.ranking_metrics(_best(C.ranked(both, 20, "target")), _truth(spark, d, cold), 20)


_CAL = f"cal AS (SELECT doc_id, quality AS label, least(greatest(0.3::DOUBLE * quality + 0.7::DOUBLE * (({h('doc_id', 's')} % 101) / 100.0::DOUBLE), 0), 1) AS score FROM labels)"


def _cal(spark, d):
    score = 0.3 * F.col("quality") + 0.7 * ((hash_order(F.col("doc_id"), "s") % 101) / 100.0)
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


@query(f"WITH {_CAL}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mr FROM cal), t AS (SELECT CAST(sum(label) AS BIGINT) AS p, CAST(count(*) - sum(label) AS BIGINT) AS n, sum(mr * label) AS s FROM r) SELECT p AS positives, n AS negatives, round((s - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS auc FROM t")
def auc_rank(spark, d):
    return evaluate.auc(_cal(spark, d))


_BIN = "CAST(least(floor(score * 10), 9) AS INTEGER)"


@query(f"WITH {_CAL} SELECT {_BIN} AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_rate FROM cal GROUP BY 1")
def ece_bins(spark, d):
    return evaluate.calibration_bins(_cal(spark, d))


@query(f"WITH {_CAL}, b AS (SELECT {_BIN} AS bin, count(*) AS n, sum(score) AS s, sum(label) AS p, sum((score - label) * (score - label)) AS q FROM cal GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(s - p)) / sum(n), 6) AS ece, round(sum(q) / sum(n), 6) AS brier FROM b")
def brier(spark, d):
    return evaluate.calibration_error(_cal(spark, d))


@query(f"WITH {_CAL}, f AS (SELECT * FROM cal WHERE {h('doc_id', 'f')} % 2 = 0), b AS (SELECT {_BIN} AS bin, avg(label) AS rate FROM f GROUP BY 1) SELECT doc_id, label, round(coalesce(rate, (SELECT avg(label) FROM f)), 6) AS calibrated FROM cal LEFT JOIN b ON b.bin = {_BIN} WHERE {h('doc_id', 'f')} % 2 = 1")
def bin_calibration(spark, d):
    """Scores of one half of the labels, calibrated on the other."""
    cal = _cal(spark, d).withColumn("half", hash_order(F.col("doc_id"), "f") % 2)
    out = evaluate.bin_calibrated(cal.where("half = 0"), cal.where("half = 1"))
    return out.select("doc_id", "label", F.round("calibrated", 6).alias("calibrated"))


@query(f"WITH {SP}{_LISTS}, t AS (SELECT user_id, item_id FROM sp WHERE llm >= 0.8), c AS (SELECT 'emb' AS label, * FROM la WHERE rank <= 10 UNION ALL SELECT 'llm', * FROM lb WHERE rank <= 10), u AS (SELECT label, t.user_id, count(*) AS n, count(c.item_id) AS h FROM t CROSS JOIN (SELECT unnest(['emb', 'llm']) AS label) l LEFT JOIN c USING (label, user_id, item_id) GROUP BY 1, 2) SELECT label, count(*) AS users, round(avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(h::DOUBLE / n), 6) AS mean_recall FROM u GROUP BY 1")
def hit_comparison(spark, d):
    """Two labelled candidate lists held against one truth."""
    from frostline.plans.retrieval import _lists

    a, b = _lists(spark, d, 10)
    truth = scored_pairs(spark, d).where("llm >= 0.8").select("user_id", "item_id")
    out = None
    for label, c in (("emb", a), ("llm", b)):
        each = truth.join(c.select("user_id", "item_id", F.lit(1).alias("hit")), ["user_id", "item_id"], "left").groupBy("user_id").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
        row = each.agg(F.lit(label).alias("label"), F.count("*").alias("users"), F.round(F.avg((F.col("h") > 0).cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.col("h") / F.col("n")), 6).alias("mean_recall"))
        out = row if out is None else out.union(row)
    return out


@query(f"WITH {_CAL}, r AS (SELECT *, CASE WHEN label = 1 THEN 'high' ELSE 'false_high' END AS kind, row_number() OVER (PARTITION BY label ORDER BY score DESC, doc_id) AS r FROM cal) SELECT kind, doc_id, CAST(r AS INTEGER) AS place FROM r WHERE r <= 5")
def case_lists(spark, d):
    w = Window.partitionBy("label").orderBy(F.col("score").desc(), "doc_id")
    r = _cal(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 5")
    return r.select(F.when(F.col("label") == 1, "high").otherwise("false_high").alias("kind"), "doc_id", "place")


# Metrics of repeated runs, as every customer segment's mean balance by nation: segments are methods, nations seeds.

_MET = "met AS (SELECT c_mktsegment AS method, 'overall' AS split, 'balance' AS metric, CAST(c_nationkey AS BIGINT) AS seed, round(avg(c_acctbal), 6) AS value FROM customer GROUP BY 1, 4)"


def _met(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").cast("long").alias("seed")).agg(F.round(F.avg("c_acctbal"), 6).alias("value"))
    return c.select("method", F.lit("overall").alias("split"), F.lit("balance").alias("metric"), "seed", "value")


@query(f"WITH {_MET} SELECT method, split, metric, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM met GROUP BY 1, 2, 3")
def seed_summary(spark, d):
    return stats.seed_summary(_met(spark, d))


_T24 = "(1 - sin(a) * (1 + " + " + ".join(f"{'*'.join(f'{2 * j - 1}.0/{2 * j}' for j in range(1, k + 1))} * pow(cos(a), {2 * k})" for k in range(1, 12)) + "))"


@query(f"""WITH {_MET}, x AS (SELECT a.split, a.metric, b.method AS comparator, a.value - b.value AS d FROM met a JOIN met b USING (seed) WHERE a.method = 'BUILDING' AND b.method = 'MACHINERY'), g AS (SELECT split, metric, comparator, count(*) AS n, avg(d) AS m, stddev_samp(d) AS s FROM x GROUP BY 1, 2, 3),
t AS (SELECT *, atan(abs(m / (s / sqrt(n))) / sqrt(n - 1.0)) AS a FROM g) SELECT split, metric, comparator, n, round(m, 6) AS mean_difference, round({_T24}, 6) AS p_value FROM t""")
def paired_ttest(spark, d):
    """Two methods over 25 matched seeds: 24 degrees of freedom."""
    declared = spark.createDataFrame([("overall", "balance", "MACHINERY")], "split string, metric string, comparator string")
    return stats.paired_test(_met(spark, d), "BUILDING", declared)


@query(f"WITH {_MET}, r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY value DESC, method) AS r FROM met) SELECT seed, method, value FROM r WHERE r = 1")
def select_best_seed(spark, d):
    return stats.best_by(_met(spark, d), "seed", "value", "method").select("seed", "method", "value")


@query(f"WITH {_MET}, g AS (SELECT method, seed, round(abs(value - 4500), 6) AS gap FROM met), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY gap, seed) AS r FROM g) SELECT method, seed, gap FROM r WHERE r = 1")
def warm_gap(spark, d):
    gaps = _met(spark, d).select("method", "seed", F.round(F.abs(F.col("value") - 4500), 6).alias("gap"))
    return stats.best_by(gaps, "method", "gap", "seed", largest=False).select("method", "seed", "gap")


@query(f"WITH {_MET} SELECT a.seed, round(a.value - b.value, 6) AS delta, round((a.value - b.value) / nullif(b.value, 0), 6) AS relative FROM met a JOIN met b USING (seed) WHERE a.method = 'BUILDING' AND b.method = 'FURNITURE'")
def method_delta(spark, d):
    m = _met(spark, d)
    one = lambda x, n: m.where(F.col("method") == x).select("seed", F.col("value").alias(n))
    both = one("BUILDING", "a").join(one("FURNITURE", "b"), "seed")
    return both.select("seed", F.round(F.col("a") - F.col("b"), 6).alias("delta"), F.round(F.try_divide(F.col("a") - F.col("b"), F.col("b")), 6).alias("relative"))


@query(f"WITH {_MET}, m AS (SELECT method, avg(value) AS v FROM met GROUP BY 1), b AS (SELECT max(v) AS best FROM m WHERE method <> 'BUILDING') SELECT method, round(v / best - 1, 6) AS gain, v >= 1.05 * best AS reaches FROM m, b")
def comparator_check(spark, d):
    m = _met(spark, d).groupBy("method").agg(F.avg("value").alias("v"))
    best = m.where("method <> 'BUILDING'").agg(F.max("v").alias("best"))
    return m.join(F.broadcast(best), F.lit(True)).select("method", F.round(F.col("v") / F.col("best") - 1, 6).alias("gain"), (F.col("v") >= 1.05 * F.col("best")).alias("reaches"))


@query("SELECT nation, metric, CAST(value AS DOUBLE) AS value FROM (SELECT n_name AS nation, count(*)::DOUBLE AS customers, round(avg(c_acctbal), 6) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) UNPIVOT (value FOR metric IN (customers, balance))")
def unpivot_metrics(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    wide = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.count("*").cast("double").alias("customers"), F.round(F.avg("c_acctbal"), 6).alias("balance"))
    return wide.unpivot("nation", ["customers", "balance"], "metric", "value")


@query("WITH w AS (SELECT n_nationkey AS shard, count(*) AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), x AS (SELECT shard, 1003::DOUBLE * weight / sum(weight) OVER () AS x FROM w), b AS (SELECT *, CAST(floor(x) AS BIGINT) AS base FROM x), r AS (SELECT *, row_number() OVER (ORDER BY x - base DESC, shard) AS r, 1003 - sum(base) OVER () AS rest FROM b), s AS (SELECT shard, base + CASE WHEN r <= rest THEN 1 ELSE 0 END AS size FROM r) SELECT shard, CAST(size AS BIGINT) AS size, CAST(coalesce(sum(size) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s")
def shard_sizes(spark, d):
    weights = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("shard")).agg(F.count("*").alias("weight"))
    return stats.shard_sizes(1003, weights)


@query("""WITH t AS (SELECT p_partkey AS item_id, unnest([x FOR x IN regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}_]+') IF length(x) >= 2]) AS term FROM part), f AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2), g AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
w AS (SELECT item_id, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM part)) / (1.0::DOUBLE + df)) + 1) AS w FROM f JOIN g USING (term)) SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w""")
def tfidf_terms(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return models.tfidf(docs, "item_id", "text").withColumn("weight", F.round("weight", 6))


@query()
def als_scores(spark, d):
    """Each user's 20 best items by implicit factorisation."""
    found = models.factorised(pairs(spark, d))
    side = lambda f: f.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("v"))
    top = C.top_candidates(side(found.userFactors), side(found.itemFactors), None, 20)
    return top.select(F.col("target").alias("user_id"), F.col("candidate_rank").alias("rank"), F.col("entity").alias("item_id"), F.col("score").cast("float").alias("score"))


@query()
def ridge_projection(spark, d):
    """User vectors mapped by ridge regression to the mean vector of the items they met."""
    import numpy as np

    from frostline.plans.base import item_vectors, user_vectors

    users, items = user_vectors(spark, d), item_vectors(spark, d)
    means = pairs(spark, d).join(items, F.col("item_id") == F.col("id")).select("user_id", F.posexplode("v").alias("k", "x")).groupBy("user_id", "k").agg(F.avg("x").alias("x")).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("y"))
    rows = stored(users.join(means, F.col("id") == F.col("user_id")).select("user_id", "v", "y"))
    w = spark.sparkContext.broadcast(models.ridge_map(rows, "v", "y"))

    def project(batches):
        for pdf in batches:
            x = np.column_stack([np.stack(pdf["v"]), np.ones(len(pdf))])
            pdf["projected"] = list(x @ w.value)
            yield pdf[["user_id", "projected"]]

    return rows.select("user_id", "v").mapInPandas(project, "user_id long, projected array<double>")


@query(f"WITH {IX} SELECT user_id, item_id, round(CAST('0x' || substr(md5('User ' || user_id || ', product ' || item_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE, 6) AS p FROM ix")
def scored_prompts(spark, d):
    """All pairs through the scorer's interface, with the stand-in scorer."""
    prompt = F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(", product "), F.col("item_id").cast("string"))
    return models.score_pairs(pairs(spark, d), models.stub_scorer, prompt).select("user_id", "item_id", F.round(F.col("predict").cast("double"), 6).alias("p"))
