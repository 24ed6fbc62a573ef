"""Queries over candidates and selectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frostline.functions.vectors import l2_normalised
from frostline.operators import candidates as C
from frostline.operators import edges as E
from frostline.operators import evaluate
from frostline.operators.ids import hash_order, numbered
from frostline.plans.base import COLD, SP, cold_items, cold_setting, grouped_pairs, h, item_vectors, pairs, query, scored_pairs
from frostline.sources.storage import stored


def _observed(train, target="item_id"):
    other = "user_id" if target == "item_id" else "item_id"
    return train.select(F.col(target).alias("target"), F.col(other).alias("entity"))


_TOP = "SELECT target, entity, round(score, 6) AS score, CAST(candidate_rank AS INTEGER) AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, entity) AS candidate_rank FROM ({}) WHERE {}) WHERE candidate_rank <= {}"


def _rounded(df):
    return df.select("target", "entity", F.round("score", 6).alias("score"), "candidate_rank")


_SIM = "SELECT c.id AS target, u.id AS entity, round(list_dot_product(c.v, u.v), 9) AS score FROM cold c, uv u"
_NOT_SEEN = "NOT EXISTS (SELECT 1 FROM train t WHERE t.item_id = target AND t.user_id = entity)"


@query(f"WITH {COLD} " + _TOP.format(_SIM, _NOT_SEEN, 50))
def cand_item_topm(spark, d):
    """Cold items to the 50 users of highest inner product."""
    cold, users, train = cold_setting(spark, d)
    return _rounded(C.top_candidates(cold, users, _observed(train), 50))


_UNIT = "[x / greatest(sqrt(list_dot_product(v, v)), 1e-12) FOR x IN v]"


@query(f"WITH {COLD}, cn AS (SELECT id, {_UNIT} AS v FROM cold), un AS (SELECT id, {_UNIT} AS v FROM uv) " + _TOP.format("SELECT c.id AS target, u.id AS entity, round(list_dot_product(c.v, u.v), 9) AS score FROM cn c, un u", _NOT_SEEN, 20))
def cand_item_cosine(spark, d):
    cold, users, train = cold_setting(spark, d)
    unit = lambda df: df.select("id", l2_normalised("v").alias("v"))
    return _rounded(C.top_candidates(unit(cold), unit(users), _observed(train), 20))


@query(f"WITH {COLD}, vis AS (SELECT * FROM iv WHERE id IN (SELECT item_id FROM train)) " + _TOP.format("SELECT u.id AS target, c.id AS entity, round(list_dot_product(c.v, u.v), 9) AS score FROM vis c, uv u", "NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = target AND t.item_id = entity)", 20))
def cand_user_topm(spark, d):
    """Users to the 20 best items that training has, without those they met."""
    _, users, train = cold_setting(spark, d)
    visible = item_vectors(spark, d, train)
    return _rounded(C.top_candidates(users, visible, _observed(train, "user_id"), 20))


_NN = f"{COLD}, cn AS (SELECT id, {_UNIT} AS v FROM cold), wn AS (SELECT id, {_UNIT} AS v FROM iv WHERE id IN (SELECT item_id FROM train)), nn0 AS (SELECT c.id AS target, w.id AS neighbour, round(list_dot_product(c.v, w.v), 9) AS score FROM cn c JOIN wn w ON c.id <> w.id), nn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, neighbour) AS rank FROM nn0 QUALIFY rank <= 30), ne AS (SELECT target, user_id AS entity, score, rank FROM nn JOIN train ON item_id = neighbour)"


def _near(spark, d, k=30, rows=None):
    """(cold items, their k warm neighbours, those items' users, what the cold items were seen with); ``rows``: ``grouped_pairs``, if they are there."""
    cold, train = cold_items(spark, d, grouped_pairs(spark, d) if rows is None else rows)
    unit = lambda df: df.select("id", l2_normalised("v").alias("v"))
    warm = item_vectors(spark, d, train)
    edges = train.select(F.col("item_id").alias("neighbour"), F.col("user_id").alias("entity"))
    return cold, C.neighbours(unit(cold), unit(warm), k), edges, _observed(train)


for _how in ("sum", "max"):

    @query(f"WITH {_NN} " + _TOP.format(f"SELECT target, entity, round({_how}(greatest(score, 0.0::DOUBLE)), 9) AS score FROM ne GROUP BY 1, 2", _NOT_SEEN, 20), f"cand_neighbor_items_{_how}")
    def cand_neighbor_items(spark, d, how=_how):
        _, near, edges, observed = _near(spark, d)
        return _rounded(C.from_neighbours(near, edges, observed, how, 20))


_NU = f"""{COLD}, un AS (SELECT id, {_UNIT} AS v FROM uv), fresh AS (SELECT * FROM un WHERE {h('id', 'u')} % 10 = 0), old AS (SELECT * FROM un WHERE {h('id', 'u')} % 10 <> 0),
nn0 AS (SELECT c.id AS target, w.id AS neighbour, round(list_dot_product(c.v, w.v), 9) AS score FROM fresh c, old w), nn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, neighbour) AS rank FROM nn0 QUALIFY rank <= 20), ne AS (SELECT target, item_id AS entity, score FROM nn JOIN train ON user_id = neighbour)"""


@query(f"WITH {_NU} " + _TOP.format("SELECT target, entity, round(sum(greatest(score, 0.0::DOUBLE)), 9) AS score FROM ne GROUP BY 1, 2", "NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = target AND t.item_id = entity)", 20))
def cand_neighbor_users(spark, d):
    """A tenth of the users, by hash, as cold: items of their most similar users."""
    _, users, train = cold_setting(spark, d)
    unit = stored(users.select("id", l2_normalised("v").alias("v"), (hash_order(F.col("id"), "u") % 10).alias("b")))
    near = C.neighbours(unit.where("b = 0").select("id", "v"), unit.where("b <> 0").select("id", "v"), 20)
    edges = train.select(F.col("user_id").alias("neighbour"), F.col("item_id").alias("entity"))
    return _rounded(C.from_neighbours(near, edges, _observed(train, "user_id"), "sum", 20))


_N3 = _NN.replace("rank <= 30", "rank <= 2")


@query(f"""WITH {_N3}, cand AS ({_TOP.format("SELECT target, entity, round(sum(greatest(score, 0.0::DOUBLE)), 9) AS score FROM ne GROUP BY 1, 2", _NOT_SEEN, 100)}),
pop AS (SELECT user_id AS entity, row_number() OVER (ORDER BY count(*) DESC, user_id) AS pop_rank FROM train GROUP BY 1),
bf AS (SELECT target, entity, score, 0 AS source, 0 AS pop_rank FROM cand UNION ALL SELECT c.id, p.entity, 0.0::DOUBLE, 1, p.pop_rank FROM cold c, pop p WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.item_id = c.id AND t.user_id = p.entity) AND NOT EXISTS (SELECT 1 FROM cand x WHERE x.target = c.id AND x.entity = p.entity))
SELECT target, entity, round(score, 6) AS score, source, CAST(r AS INTEGER) AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source, score DESC, pop_rank, entity) AS r FROM bf) WHERE r <= 100""")
def cand_popularity_backfill(spark, d):
    cold, near, edges, observed = _near(spark, d, 2)
    cand = stored(C.from_neighbours(near, edges, observed, "sum", 100))
    counts = edges.groupBy("entity").agg(F.count("*").alias("n"))
    popular = numbered(counts, F.col("n").desc(), "entity", name="pop_rank").select("entity", F.col("pop_rank").cast("int").alias("pop_rank"))
    out = C.popularity_backfill(cand, cold, popular, observed, 100)
    return out.select("target", "entity", F.round("score", 6).alias("score"), "source", "candidate_rank")


@query(f"""WITH {_NN}, f AS (SELECT target, entity, sum(score) AS s, max(score) AS mx, count(*) AS c, sum(score / log2(rank + 1)) AS decay, sum(score * score) AS sq, sum(sqrt(score)) AS root FROM ne WHERE score > 0 AND {_NOT_SEEN.replace('target', 'ne.target').replace('= entity', '= ne.entity')} GROUP BY 1, 2),
p AS (SELECT user_id AS entity, count(*) AS pop FROM train GROUP BY 1), g AS (SELECT f.*, ln(1.0::DOUBLE + pop) AS p FROM f JOIN p USING (entity)),
l AS (SELECT target, entity, unnest(['sum', 'max', 'avg', 'count', 'rank_decay', 'sum_sq', 'sum_sqrt', 'sum_count_boost', 'sum_idf025', 'sum_idf050', 'sum_idf100', 'sum_pop025', 'sum_pop050']) AS policy, round(unnest([s, mx, s / c, c + 1e-6 * s, decay, sq, root, s * ln(1.0::DOUBLE + c), s / pow(p, 0.25), s / pow(p, 0.5), s / p, s * pow(p, 0.25), s * pow(p, 0.5)]), 9) AS score FROM g)
SELECT policy, target, entity, CAST(r AS INTEGER) AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY policy, target ORDER BY score DESC, entity) AS r FROM l) WHERE r <= 20""")
def policy_search(spark, d):
    """Thirteen scoring policies from one aggregation of neighbours."""
    _, near, edges, observed = _near(spark, d)
    feats = C.neighbour_features(near, edges, observed)
    scores = C.policy_scores(feats, edges.groupBy("entity").agg(F.count("*").alias("pop")))
    return C.ranked(scores, 20, "policy", "target").select("policy", "target", "entity", "candidate_rank")


@query(f"WITH {COLD}, s AS ({_SIM}), z AS (SELECT target, entity, round((score - avg(score) OVER w) / greatest(coalesce(stddev_samp(score) OVER w, 0.0::DOUBLE), 1e-6), 6) AS score FROM s WINDOW w AS (PARTITION BY target)) " + _TOP.format("SELECT * FROM z", _NOT_SEEN, 20))
def cand_hybrid_zscore(spark, d):
    """Scores standardised per target over the whole pool, then ranked: the order is that of the scores."""
    cold, users, train = cold_setting(spark, d)
    return _rounded(C.standardised_candidates(cold, users, _observed(train), 20))


_TRUTH = f"{COLD}, cand AS ({_TOP.format(_SIM, _NOT_SEEN, 50)}), truth AS (SELECT user_id, item_id FROM ix WHERE item_id IN (SELECT id FROM cold))"


def _pool(spark, d):
    cold, users, train = cold_setting(spark, d)
    cand = C.top_candidates(cold, users, _observed(train), 50).select(F.col("target").alias("item_id"), F.col("entity").alias("user_id"), "score", "candidate_rank")
    truth = stored(pairs(spark, d)).join(cold.select(F.col("id").alias("item_id")), "item_id", "left_semi").select("user_id", "item_id")
    return stored(cand), truth


@query(f"""WITH {_TRUTH}, t AS (SELECT truth.item_id, c.target IS NOT NULL AS hit FROM truth LEFT JOIN cand c ON c.target = item_id AND c.entity = user_id), e AS (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE hit) AS h FROM t GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(h) AS BIGINT) AS hits, count(*) AS entities, count(*) FILTER (WHERE h > 0) AS entities_hit, round(sum(h)::DOUBLE / sum(n), 6) AS pair_recall, round(avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS entity_hit_rate FROM e""")
def hit_stats(spark, d):
    cand, truth = _pool(spark, d)
    return evaluate.hit_stats(cand, truth, "item_id")


_DCG = "(SELECT sum(1 / log2(x + 1.0::DOUBLE)) FROM range(1, {} + 1) t(x))"


@query(f"""WITH {_TRUTH}, r AS (SELECT entity AS user_id, target AS item_id, row_number() OVER (PARTITION BY entity ORDER BY score DESC, target) AS rank FROM cand), u AS (SELECT user_id, count(*) AS n FROM truth GROUP BY 1),
hh AS (SELECT user_id, count(*) AS h, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM r JOIN truth USING (user_id, item_id) WHERE rank <= 20 GROUP BY 1), ideal AS (SELECT k, sum(1 / log2(x + 1.0::DOUBLE)) AS g FROM range(1, 21) a(k), range(1, 21) b(x) WHERE x <= k GROUP BY 1)
SELECT count(*) AS users, CAST(sum(coalesce(h, 0)) AS BIGINT) AS hits, round(avg(coalesce(h, 0)::DOUBLE / n), 6) AS recall, round(avg(coalesce(h, 0) / 20.0::DOUBLE), 6) AS precision, round(avg(coalesce(dcg, 0) / g), 6) AS ndcg FROM u LEFT JOIN hh USING (user_id) JOIN ideal ON k = least(n, 20)""")
def candidate_ndcg(spark, d):
    cand, truth = _pool(spark, d)
    by_user = Window.partitionBy("user_id").orderBy(F.round("score", 6).desc(), "item_id")
    return evaluate.ranking_metrics(cand.withColumn("rank", F.row_number().over(by_user)), truth, 20)


@query(f"""WITH {_TRUTH}, u AS (SELECT user_id, count(*) AS n FROM truth GROUP BY 1), hh AS (SELECT user_id, count(*) AS h FROM truth JOIN cand ON target = item_id AND entity = user_id GROUP BY 1),
g AS (SELECT k, coalesce(sum(1 / log2(x + 1.0::DOUBLE)) FILTER (WHERE x <= k), 0) AS g FROM range(0, 21) a(k), range(1, 21) b(x) GROUP BY 1), e AS (SELECT n, coalesce(h, 0) AS h FROM u LEFT JOIN hh USING (user_id))
SELECT count(*) AS users, round(avg(least(h, 20)::DOUBLE / n), 6) AS oracle_recall, round(avg(a.g / b.g), 6) AS oracle_ndcg, round(sum(h)::DOUBLE / sum(n), 6) AS pair_recall FROM e JOIN g a ON a.k = least(h, 20) JOIN g b ON b.k = least(n, 20)""")
def pool_oracle(spark, d):
    cand, truth = _pool(spark, d)
    return evaluate.pool_oracle(cand, truth, 20)


# Selectors, over all pairs as scored candidates.


def _edge_sql(rule: str) -> str:
    return f"WITH {SP}{rule}"


_OUT = "user_id, item_id, entity_type"


def _threshold_sql(least: str, p: str) -> str:
    return _edge_sql(f""", w AS (SELECT *, row_number() OVER (PARTITION BY item_id, entity_type ORDER BY llm DESC, user_id) AS r, sum(CASE WHEN llm >= 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id, entity_type) AS above FROM sp), k AS (SELECT *, count(*) OVER (PARTITION BY item_id, entity_type) AS n FROM w WHERE r <= least({least}, 12)) SELECT {_OUT}, {p} AS probability FROM k""")


@query(_threshold_sql("above", "llm"))
def edges_threshold(spark, d):
    return E.kept_above(scored_pairs(spark, d).withColumnRenamed("llm", "score"), 0.7, 12)


@query(_threshold_sql("greatest(above + 1, 5)", "CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE round(1.0 - 0.4::DOUBLE * (r - 1) / (n - 1), 6) END"))
def edges_threshold_backfill(spark, d):
    """A minimum adds one row even where it is reached."""
    return E.kept_above(scored_pairs(spark, d).withColumnRenamed("llm", "score"), 0.7, 12, 5, True, "rank").withColumn("probability", F.round("probability", 6))


_MM = "CASE WHEN max({0}) OVER {1} > min({0}) OVER {1} THEN ({0} - min({0}) OVER {1}) / (max({0}) OVER {1} - min({0}) OVER {1}) ELSE {2} END"


def _blend_sql(by: str, other: str, limit: str, weight: float) -> str:
    w = f"(PARTITION BY {by}, entity_type)"
    return _edge_sql(f""", b AS (SELECT *, round({weight}::DOUBLE * {_MM.format('llm', w, 0.5)} + (1 - {weight}::DOUBLE) * {_MM.format('emb', w, 0.5)}, 9) AS blend FROM sp), r AS (SELECT *, row_number() OVER (PARTITION BY {by}, entity_type ORDER BY blend DESC, llm DESC, emb DESC, {other}) AS r FROM b), k AS (SELECT *, count(*) OVER {w} AS n FROM r WHERE r <= {limit})
SELECT {_OUT}, blend, CAST(r AS INTEGER) AS rank, round(CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE 1.0 - 0.4::DOUBLE * (r - 1) / (n - 1) END, 6) AS probability FROM k""")


def _blend(df):
    return df.select("user_id", "item_id", "entity_type", "blend", "rank", F.round("probability", 6).alias("probability"))


@query(_blend_sql("item_id", "user_id", "20", 0.6))
def edges_blend_item(spark, d):
    return _blend(E.blended(scored_pairs(spark, d), "item_id", 0.6, 20))


@query(_blend_sql("user_id", "item_id", "CASE entity_type WHEN 'warmup' THEN 5 ELSE 10 END", 0.3))
def edges_blend_user(spark, d):
    return _blend(E.blended(scored_pairs(spark, d), "user_id", 0.3, {"warmup": 5, "strict_cold": 10}))


@query(_edge_sql(f""", c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY emb DESC, item_id) AS cr, count(*) OVER (PARTITION BY user_id) AS n FROM sp), m AS (SELECT *, {_MM.format('emb', '(PARTITION BY user_id)', 'CASE WHEN n <= 1 THEN 1.0 ELSE 1 - (cr - 1)::DOUBLE / (n - 1) END')} AS content FROM c),
y AS (SELECT *, round(least(greatest(0.4::DOUBLE * content + 0.6::DOUBLE * llm, 0.0::DOUBLE), 1.0::DOUBLE), 9) AS hybrid FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hybrid DESC, content DESC, llm DESC, item_id) AS r FROM y WHERE hybrid >= 0.5) SELECT {_OUT}, round(hybrid, 6) AS probability FROM k WHERE r <= 10"""))
def edges_hybrid(spark, d):
    return E.hybrid(scored_pairs(spark, d), 0.4, 0.5, 10).withColumn("probability", F.round("probability", 6))


_CR = ", c AS (SELECT *, row_number() OVER (PARTITION BY entity_type, user_id ORDER BY emb DESC, item_id) AS content_rank FROM sp)"


@query(_edge_sql(_CR + f" SELECT {_OUT}, round(greatest(1 - (content_rank - 1) / 20.0::DOUBLE, 0.05), 6) AS linear, round(greatest(1.0::DOUBLE / content_rank, 0.05), 6) AS inverse, round(greatest(pow(0.9::DOUBLE, content_rank - 1), 0.05), 6) AS exponential FROM c WHERE content_rank <= 20"))
def edges_rank_weight(spark, d):
    r = E.content_ranked(scored_pairs(spark, d)).where("content_rank <= 20")
    return r.select("user_id", "item_id", "entity_type", *[F.round(E.rank_weight(F.col("content_rank"), 20, m), 6).alias(m) for m in ("linear", "inverse", "exponential")])


@query(_edge_sql(_CR + f", k AS (SELECT *, row_number() OVER (PARTITION BY entity_type, user_id ORDER BY CASE WHEN llm >= 0.5 THEN 0 ELSE 1 END, content_rank) AS r FROM c) SELECT {_OUT}, CAST(r AS INTEGER) AS rank FROM k WHERE r <= 10"))
def edges_high_first(spark, d):
    return E.high_first(scored_pairs(spark, d), 0.5, 10)


@query(_edge_sql(_CR.replace("c AS (", "c AS MATERIALIZED (") + f""", weak AS MATERIALIZED (SELECT entity_type, user_id, content_rank, row_number() OVER (PARTITION BY entity_type, user_id ORDER BY content_rank) AS nth FROM c WHERE content_rank > 4 AND content_rank <= 10 AND llm < 0.5), strong AS MATERIALIZED (SELECT entity_type, user_id, item_id AS new_item, row_number() OVER (PARTITION BY entity_type, user_id ORDER BY content_rank) AS nth FROM c WHERE content_rank > 10 AND llm >= 0.5), s AS (SELECT entity_type, user_id, content_rank, new_item FROM weak JOIN strong USING (entity_type, user_id, nth))
SELECT user_id, coalesce(new_item, item_id) AS item_id, entity_type, CAST(content_rank AS INTEGER) AS rank, new_item IS NOT NULL AS swapped FROM c LEFT JOIN s USING (entity_type, user_id, content_rank) WHERE content_rank <= 10"""))
def edges_tail_swap(spark, d):
    return E.tail_swap(scored_pairs(spark, d), 0.5, 4, 10)


@query(_edge_sql(f""", g AS (SELECT item_id, count(*) AS n FROM ix GROUP BY 1), pop AS (SELECT item_id, ln(1.0::DOUBLE + n) / max(ln(1.0::DOUBLE + n)) OVER () AS popularity FROM g), p AS (SELECT sp.*, round(llm - 0.2::DOUBLE * popularity, 9) AS rs FROM sp JOIN pop USING (item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, entity_type ORDER BY CASE WHEN llm >= 0.8 THEN 0 ELSE 1 END, rs DESC, llm DESC, item_id) AS r, least(greatest(sum(CASE WHEN llm >= 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, entity_type), 2), 6) AS keep FROM p),
i AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rs DESC, llm DESC, user_id, entity_type) AS nth FROM k WHERE r <= keep) SELECT {_OUT}, llm AS probability FROM i WHERE nth <= 3"""))
def edges_quota(spark, d):
    g = pairs(spark, d).groupBy("item_id").agg(F.log1p(F.count("*").cast("double")).alias("l"))
    pop = g.join(F.broadcast(g.agg(F.max("l").alias("m"))), F.lit(True)).select("item_id", (F.col("l") / F.col("m")).alias("popularity"))
    return E.quota(scored_pairs(spark, d).withColumnRenamed("llm", "score"), pop, 0.2, 0.8, 6, 2, 3)


@query(_edge_sql(f", k AS (SELECT *, row_number() OVER (PARTITION BY user_id, entity_type ORDER BY llm DESC, item_id) AS r FROM sp WHERE llm >= 0.3) SELECT {_OUT}, llm AS probability FROM k WHERE r <= CASE entity_type WHEN 'strict_cold' THEN 8 ELSE 4 END"))
def edges_budget(spark, d):
    w = Window.partitionBy("user_id", "entity_type").orderBy(F.col("llm").desc(), "item_id")
    rows = scored_pairs(spark, d).where("llm >= 0.3").withColumn("r", F.row_number().over(w))
    return rows.where(F.col("r") <= E.budget({"strict_cold": 8}, 4)).select("user_id", "item_id", "entity_type", F.col("llm").alias("probability"))


_LISTS = ", la AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY emb DESC, item_id) AS rank FROM sp), lb AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY llm DESC, item_id) AS rank FROM sp)"


def _lists(spark, d, n):
    sp = scored_pairs(spark, d)
    one = lambda c: sp.select("user_id", "item_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col(c).desc(), "item_id")).alias("rank")).where(F.col("rank") <= n)
    return one("emb"), one("llm")


@query(_edge_sql(_LISTS + f""", f AS (SELECT user_id, item_id, round(sum(s), 9) AS score FROM (SELECT user_id, item_id, 1.0::DOUBLE / (60 + rank) AS s FROM la WHERE rank <= 30 UNION ALL SELECT user_id, item_id, 0.5::DOUBLE / (60 + rank) FROM lb WHERE rank <= 30) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS r FROM f)
SELECT user_id, item_id, CAST(r AS INTEGER) AS rank, round({_MM.format('score', '(PARTITION BY user_id)', 1.0)}, 6) AS probability FROM r WHERE r <= 20"""))
def edges_rrf(spark, d):
    a, b = _lists(spark, d, 30)
    return E.reciprocal_rank_fusion([(a, 1.0), (b, 0.5)], 60.0, 20).withColumn("probability", F.round("probability", 6))


@query(_edge_sql(_LISTS + """, u AS (SELECT user_id, item_id, CASE WHEN rank <= 5 THEN 0 ELSE 2 END AS o, rank FROM la WHERE rank <= 30 UNION ALL SELECT user_id, item_id, 1, rank FROM lb WHERE rank <= 10), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY o, rank) AS k FROM u), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, rank, item_id) AS r FROM f WHERE k = 1) SELECT user_id, item_id, CAST(r AS INTEGER) AS rank FROM g WHERE r <= 15"""))
def edges_core_tail(spark, d):
    a, b = _lists(spark, d, 30)
    return E.core_tail(a, b.where("rank <= 10"), 5, 15)


@query(_edge_sql(f" SELECT {_OUT}, max(p) AS probability FROM (SELECT {_OUT}, llm AS p FROM sp UNION ALL SELECT {_OUT}, least(coalesce(CASE WHEN llm < 0.9 THEN emb * 1.5::DOUBLE END, 1.0), 1.0::DOUBLE) FROM sp) GROUP BY 1, 2, 3"))
def edges_merge(spark, d):
    sp = scored_pairs(spark, d)
    one = sp.select("user_id", "item_id", "entity_type", F.col("llm").alias("probability"))
    two = sp.select("user_id", "item_id", "entity_type", F.when(F.col("llm") < 0.9, F.col("emb") * 1.5).alias("probability"))
    return E.merged(one, two)


@query(_edge_sql(f" SELECT {_OUT}, round(pow(CASE entity_type WHEN 'strict_cold' THEN llm ELSE emb END, 1.5), 6) AS probability FROM sp"))
def edges_groupwise(spark, d):
    sp = scored_pairs(spark, d)
    part = lambda c: sp.select("user_id", "item_id", "entity_type", F.col(c).alias("probability"))
    return E.by_source(part("llm"), part("emb"), 1.5).withColumn("probability", F.round("probability", 6))


_K = "user_id || '-' || item_id"


@query(_edge_sql(f", ref AS (SELECT entity_type, count(*) AS n FROM sp WHERE llm >= 0.9 GROUP BY 1), r AS (SELECT sp.*, row_number() OVER (PARTITION BY entity_type ORDER BY {h(_K, 7)}, user_id, item_id) AS r FROM sp) SELECT {_OUT}, 1.0::DOUBLE AS probability FROM r JOIN ref USING (entity_type) WHERE r <= n"))
def edges_ablation(spark, d):
    """A random set as large, by entity type, as the selected one."""
    sp = scored_pairs(spark, d)
    ref = sp.where("llm >= 0.9").groupBy("entity_type").agg(F.count("*").alias("n"))
    key = hash_order(F.concat_ws("-", "user_id", "item_id"), 7)
    ranked = numbered(sp.select("user_id", "item_id", "entity_type", key.alias("k")), "entity_type", "k", "user_id", "item_id", name="g")
    first = ranked.groupBy("entity_type").agg(F.min("g").alias("g0"))
    limit = F.broadcast(first.join(ref, "entity_type"))  # one row an entity type
    return ranked.join(limit, "entity_type").where("g - g0 < n").select("user_id", "item_id", "entity_type", F.lit(1.0).alias("probability"))


@query(_edge_sql(f""" SELECT {_OUT}, llm, round({_MM.format('llm', '(PARTITION BY entity_type, user_id)', 0.5)}, 6) AS scaled, round(avg(llm) OVER w, 9) AS mean, round(coalesce(stddev_samp(llm) OVER w, 0), 6) AS sd,
round(coalesce(least(greatest((lag(llm) OVER o - llm) / nullif(max(llm) OVER w - min(llm) OVER w, 0), 0), 10), 0), 6) AS gap_before, round(coalesce(least(greatest((llm - lead(llm) OVER o) / nullif(max(llm) OVER w - min(llm) OVER w, 0), 0), 10), 0), 6) AS gap_after
FROM sp WINDOW w AS (PARTITION BY entity_type, user_id), o AS (PARTITION BY entity_type, user_id ORDER BY llm DESC, item_id)"""))
def rerank_features(spark, d):
    w = Window.partitionBy("entity_type", "user_id")
    o = w.orderBy(F.col("llm").desc(), "item_id")
    span = F.nullif(F.max("llm").over(w) - F.min("llm").over(w), F.lit(0.0))
    gap = lambda x: F.round(F.coalesce(F.least(F.greatest(x / span, F.lit(0.0)), F.lit(10.0)), F.lit(0.0)), 6)
    llm = F.col("llm")
    return scored_pairs(spark, d).select(
        "user_id", "item_id", "entity_type", "llm", F.round(E.group_minmax(llm, w), 6).alias("scaled"), F.round(F.avg(llm).over(w), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp(llm).over(w), F.lit(0.0)), 6).alias("sd"),
        gap(F.lag(llm).over(o) - llm).alias("gap_before"), gap(llm - F.lead(llm).over(o)).alias("gap_after"),
    )
