"""Readers and writers on files of their own, errors they must raise, and learned factors against their rules."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import candidates, complement, factors, filters, models, stats
from frostline.sources import sinks, tables


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"k": 1}\n{"k": \n\n{"k": 3}\n')
    got = tables.read_predictions(spark, str(tmp_path / "a.txt"), "k int").orderBy("row_idx").collect()
    assert [(r["row_idx"], r["valid"], r["parsed"]["k"] if r["parsed"] else None) for r in got] == [(0, True, 1), (1, False, None), (2, False, None), (3, True, 3)]
    (tmp_path / "b.dat").write_bytes("1::Caf\xe9::3\n".encode("latin1"))
    assert tuple(tables.read_separated(spark, str(tmp_path / "b.dat"), ["a", "b", "c"]).first()) == ("1", "Café", "3")
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sorted(r["a"] for r in tables.read_json_array(spark, str(tmp_path / "c.json"), "a int").collect()) == [1, 2]
    with pytest.raises(FileNotFoundError):
        tables.read_pairs(spark, str(tmp_path / "none.csv"))
    assert tables.read_pairs(spark, str(tmp_path / "none.csv"), empty_ok=True).count() == 0
    assert tables.reviews_path("meta", "X") == "raw/meta_categories/meta_X.jsonl"
    with pytest.raises(ValueError):
        tables.reviews_path("other", "X")


def test_matrix(spark, tmp_path):
    x = np.arange(21, dtype=np.float32).reshape(7, 3)
    np.save(tmp_path / "m.npy", x)
    got = tables.read_matrix(spark, str(tmp_path / "m.npy"), rows_a_task=2).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(7)) and np.array_equal(np.array([r["v"] for r in got]), x)
    np.save(tmp_path / "v.npy", np.arange(3))
    with pytest.raises(ValueError):
        tables.read_matrix(spark, str(tmp_path / "v.npy"))
    with pytest.raises(ValueError):
        tables.checked_matrix(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>"))


def test_shards_that_lack_rows_are_an_error(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "row_idx").withColumn("x", F.col("row_idx") * 2)
    weights = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 0)], "shard long, weight long")
    manifest = sinks.write_shards(rows, str(tmp_path / "parts"), weights)
    assert sum(r["size"] for r in manifest.collect()) == 10
    merged = sinks.merge_shards(spark, str(tmp_path / "parts"), manifest, str(tmp_path / "out"))
    assert sorted(map(tuple, merged.collect())) == [(k, 2 * k) for k in range(10)]
    with pytest.raises(FileExistsError):
        sinks.merge_shards(spark, str(tmp_path / "parts"), manifest, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="manifest"):
        sinks.merge_shards(spark, str(tmp_path / "parts"), manifest.withColumn("size", F.col("size") + 1), str(tmp_path / "other"))


def test_zip_of_unequal_lengths_is_an_error(spark):
    a, b = spark.range(3).withColumnRenamed("id", "row_idx"), spark.range(4).withColumnRenamed("id", "row_idx")
    with pytest.raises(ValueError):
        tables.zipped(a, b)
    with pytest.raises(ValueError):
        filters.with_defaults(a)


def test_undeclared_comparator_is_an_error(spark):
    rows = [(m, "s", x, k, float(k + len(m))) for m in ("one", "three") for x in ("p", "q") for k in range(5)]
    metrics = spark.createDataFrame(rows, "method string, split string, metric string, seed long, value double")
    declared = lambda *cells: spark.createDataFrame(list(cells), "split string, metric string, comparator string")
    with pytest.raises(ValueError, match="declared"):
        stats.declared_test(metrics, "one", declared(("s", "p", "three")))
    with pytest.raises(ValueError, match="declared"):
        stats.declared_test(metrics, "one", declared(("s", "p", "three"), ("s", "q", "absent")))
    assert stats.declared_test(metrics, "one", declared(("s", "p", "three"), ("s", "q", "three"))).count() == 2


def test_sums_of_a_hot_id(spark):
    rows = [(k % 3 if k % 2 else 0, [float(k), 1.0]) for k in range(3000)]
    got = {r["id"]: (r["n"], r["v"]) for r in models.summed_vectors(spark.createDataFrame(rows, "id long, v array<double>").repartition(5)).collect()}
    for i in (0, 1, 2):
        of = [v for j, v in rows if j == i]
        assert got[i] == (len(of), [sum(v[0] for v in of), float(len(of))])


def test_bounded_and_blocked_pools_agree(spark):
    rng = np.random.default_rng(1)
    df = lambda n, a: spark.createDataFrame([(a + k, [float(x) for x in rng.integers(-3, 4, 4)]) for k in range(n)], "id long, v array<double>")
    targets, pool = df(30, 0).cache(), df(70, 100).cache()
    most = targets.select(F.col("id").alias("target"), F.lit(6).cast("long").alias("k"))
    best = lambda **p: sorted(map(tuple, candidates.ranked(candidates.similarities(targets, pool, most, **p), 6, "target").collect()))
    assert best() == best(block=16, most_bytes=0)
    one = {r["target"]: (r["mean"], r["sd"]) for r in candidates.score_moments(targets, pool).collect()}
    for parameters in ({}, {"block": 16, "most_bytes": 0}):
        for t, m, s in candidates.rounded_moments(targets, pool, **parameters).collect():
            assert one[t] == pytest.approx((m, s), abs=1e-7)
    x, y = (np.array([r["v"] for r in f.orderBy("id").collect()]) for f in (targets, pool))
    assert [one[t] for t in sorted(one)] == [pytest.approx((m, s)) for m, s in zip((x @ y.T).mean(axis=1), (x @ y.T).std(axis=1, ddof=1))]


def test_standardised_candidates_bring_all_ties(spark):
    """Sixty vectors within one step of rounding: the twenty of smallest id are taken, however many tie."""
    pool = spark.createDataFrame([(k, [1.0 + 2e-9 * k, 0.0]) for k in range(60)] + [(100 + k, [-float(k), 1.0]) for k in range(30)], "id long, v array<double>")
    targets = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.5])], "id long, v array<double>")
    for seen in (None, spark.createDataFrame([(1, 3), (2, 129)], "target long, entity long")):
        got = candidates.standardised_candidates(targets, pool, seen, 20).collect()
        want = [k for k in range(60) if seen is None or k != 3][:20]
        assert [r["entity"] for r in sorted(got, key=lambda r: (r["target"], r["candidate_rank"])) if r["target"] == 1] == want
        assert sum(r["target"] == 2 for r in got) == 20 and next(r["entity"] for r in got if (r["target"], r["candidate_rank"]) == (2, 1)) == (129 if seen is None else 128)


def test_backfill_by_brute_force(spark):
    rng = np.random.default_rng(2)
    popular = [(int(e), k + 1) for k, e in enumerate(rng.permutation(50))]
    have = sorted({(t, int(e), round(float(rng.random()), 3)) for t in range(12) for e in rng.choice(50, t, replace=False)})
    seen = sorted({(t, int(e)) for t in range(13) for e in rng.choice(50, 3 * t, replace=False)} - {(t, e) for t, e, _ in have})
    frames = (spark.createDataFrame(have, "target long, entity long, score double"), spark.range(14), spark.createDataFrame(popular, "entity long, pop_rank int"), spark.createDataFrame(seen, "target long, entity long"))
    got = sorted((r["target"], r["candidate_rank"], r["entity"], r["score"], r["source"]) for r in candidates.popularity_backfill(*frames, 8).collect())
    want = []
    for t in range(14):
        rows = sorted(((-s, e) for u, e, s in have if u == t))[:8]
        taken = {e for u, e, _ in have if u == t} | {e for u, e in seen if u == t}
        fill = [e for e, _ in popular if e not in taken][: 8 - len(rows)]
        want += [(t, k + 1, e, -s, 0) for k, (s, e) in enumerate(rows)] + [(t, len(rows) + k + 1, e, 0.0, 1) for k, e in enumerate(fill)]
    assert got == want


def test_text_factors_are_the_first_singular_vectors(spark):
    rng = np.random.default_rng(4)
    topics = ["red apple fruit tree", "fast car road wheel", "deep sea fish boat"]
    docs = [(k, " ".join(rng.choice(topics[k % 3].split(), 6)) + f" w{k % 11}") for k in range(120)] + [(500, None), (501, "")]
    got = {r["id"]: np.array(r["v"]) for r in models.text_factors(spark.createDataFrame(docs, "id long, text string"), 3, rounds=40).collect()}
    assert len(got) == 122 and np.allclose(got[500], 0) and np.allclose(got[501], 0)
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StopWordsRemover

    words = RegexTokenizer(inputCol="text", outputCol="raw", pattern=r"\W+", minTokenLength=2).transform(spark.createDataFrame([(i, t or "") for i, t in docs], "id long, text string"))
    words = NGram(inputCol="words", outputCol="two").transform(StopWordsRemover(inputCol="raw", outputCol="words").transform(words)).selectExpr("id", "concat(words, two) as terms")
    counts = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=976).fit(words).transform(words)
    a = {r["id"]: r["x"].toArray() for r in IDF(inputCol="tf", outputCol="x").fit(counts).transform(counts).collect()}
    ids = sorted(a)
    x = np.array([a[i] for i in ids])
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want, found = unit(x @ vt[:3].T), np.array([got[i] for i in ids])
    assert s[2] > 1.02 * s[3] and np.allclose(np.abs((found * want).sum(axis=0)), (want * want).sum(axis=0), atol=1e-3)
    assert np.allclose(found @ found.T, want @ want.T, atol=1e-2)


@pytest.mark.parametrize("layers", [0, 1])
def test_training_by_a_single_process(spark, layers):
    """Adam on pairwise log loss over the same draws, vector by vector; with a layer over the graph, gradients go back over it."""
    met = [(u, i) for u in range(12) for i in range(15) if (u * 7 + i * 3) % 4 == 0]
    pairs = spark.createDataFrame(met, "user_id long, item_id long")
    items = spark.range(15).withColumnRenamed("id", "item_id")
    seed, per, steps, rate, ridge = 7, 200, 2, 0.05, 1e-4
    got = {(r["side"], r["id"]): np.array(r["v"]) for r in factors.trained(pairs, items, dim=3, epochs=2, per_epoch=per, layers=layers, rate=rate, ridge=ridge, seed=seed, steps=steps).collect()}
    key = lambda side, i: 2 * i + (side == "i")
    h = lambda k, c: int(hashlib.md5(f"{seed}:{k}-{c}".encode()).hexdigest()[:8], 16) / 2**32
    nodes = sorted(got)
    at = {n: k for k, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for u, i in met:
        w = 1 / np.sqrt(sum(x == u for x, _ in met) * sum(y == i for _, y in met))
        a[at["u", u], at["i", i]] = a[at["i", i], at["u", u]] = w
    mixed = lambda x: (x + a @ x) / 2 if layers else x
    v = np.array([[0.2 * (h(key(*n), c) - 0.5) for c in (1, 2, 3)] for n in nodes])
    m, s, t = np.zeros_like(v), np.zeros_like(v), 0
    for epoch in range(2):
        drawn = complement.negative_triples(pairs, items, per, seed * 1000 + epoch).collect()
        for part in range(steps):
            t, g, met_ = t + 1, np.zeros_like(v), np.zeros(len(nodes))
            shown = mixed(v)
            for r in (r for r in drawn if r["j"] % steps == part):
                p, q, n = at["u", r["user_id"]], at["i", r["positive"]], at["i", r["negative"]]
                x, y, z = shown[p], shown[q], shown[n]
                w = -1 / (1 + np.exp((y - z) @ x))
                for k, d in ((p, w * (y - z) + ridge * x), (q, w * x + ridge * y), (n, -w * x + ridge * z)):
                    g[k] += d / (per // steps)
                    met_[k] = 1
            on = (met_ + (a > 0) @ met_ * layers) > 0
            g = mixed(g)
            m[on], s[on] = 0.9 * m[on] + 0.1 * g[on], 0.999 * s[on] + 0.001 * g[on] ** 2
            v[on] -= rate * (m[on] / (1 - 0.9**t)) / (np.sqrt(s[on] / (1 - 0.999**t)) + 1e-8)
    want = mixed(v)
    assert all(np.allclose(got[n], want[at[n]], atol=1e-9) for n in nodes)


def test_search_holds_tiles_and_copies_once(spark):
    """Copies on both sides, ties by rounding, targets of different depth: as brute force; a block of a small side is sent once."""
    rng = np.random.default_rng(6)
    rows = lambda n, a, kinds: [(a + k, [float(x) for x in np.random.default_rng(k % kinds).integers(-2, 3, 3) / 7]) for k in rng.permutation(n).tolist()]
    pool, seen = rows(5_000, 10_000, 40), [(t, 10_000 + int(e)) for t in range(60) for e in rng.choice(5_000, t % 7, replace=False)] + [(3, 77)]
    df = lambda x: spark.createDataFrame(x, "id long, v array<double>")
    for kinds in (9, 60):
        targets = rows(60, 0, kinds)
        got = candidates.top_candidates(df(targets), df(pool), spark.createDataFrame(seen, "target long, entity long"), 5).collect()
        for t, v in targets:
            scores = sorted((-round(float(np.dot(v, w)), 9), e) for e, w in pool if (t, e) not in set(seen))[:5]
            assert [(r.entity, r.candidate_rank) for r in sorted(got, key=lambda r: r.candidate_rank) if r.target == t] == [(e, k + 1) for k, (_, e) in enumerate(scores)]
    a, b = rng.normal(size=(300, 4)), rng.normal(size=(9_000, 4))
    k = rng.integers(1, 30, 300)
    got = candidates._best(a, np.arange(300), k, b, rng.permutation(9_000))
    assert np.array_equal(np.bincount(got.column("target").to_numpy()), k)


def test_search_holds_little(spark):
    """A task's scores of a pool of 200,000 rows aren't held at once: 256 targets' would take 400 MB."""
    import tracemalloc

    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(256, 8)), rng.normal(size=(200_000, 8))
    tracemalloc.start()
    got = candidates._best(a, np.arange(256), np.full(256, 20), b, np.arange(200_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 256 * 20 and peak < 60 * 2**20


def test_search_of_a_pool_of_copies(spark, monkeypatch):
    """A pool too large to send in which each vector has many rows: as brute force, by a third of the products; vectors tie, a third of all rows is one."""
    rng = np.random.default_rng(8)
    kinds = rng.integers(-2, 3, (60, 3)) / 7
    pool = [(1_000 + int(e), kinds[0 if k % 3 == 0 else k % 60].tolist()) for k, e in enumerate(rng.permutation(900))]
    targets = [(t, rng.integers(-2, 3, 3).astype(float).tolist()) for t in range(25)]
    df = lambda x: spark.createDataFrame(x, "id long, v array<double>")
    most = spark.createDataFrame([(t, 1 + t * 3) for t in range(25)], "target long, k long")
    met, against = [], candidates._against_pool
    monkeypatch.setattr(candidates, "_against_pool", lambda wanted, pool, *p: (met.append(wanted.count() * pool.count()), against(wanted, pool, *p))[1])
    got = candidates.similarities(df(targets), df(pool), most, most_bytes=0).collect()
    assert sum(met) <= 25 * 900 // 3
    for t, v in targets:
        rows = sorted((-r.score, r.entity) for r in got if r.target == t)
        assert len(set(rows)) == len(rows)
        assert rows[: 1 + t * 3] == sorted((-round(float(np.dot(v, w)), 9), e) for e, w in pool)[: 1 + t * 3]


def test_training_carries_drawn_nodes_only(spark, monkeypatch):
    """Steps store the nodes that triples have, not all; others keep their first vectors."""
    sizes, keep = [], factors.stored

    def counted(df):
        out = keep(df)
        if out.columns == ["key", "v", "m", "s", "moves"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(factors, "stored", counted)
    pairs = spark.range(3_000).selectExpr("id as user_id", "(id * 7) % 500 as item_id")
    got = factors.trained(pairs, spark.range(500).withColumnRenamed("id", "item_id"), dim=2, epochs=1, per_epoch=20, steps=2)
    assert got.count() == got.select("side", "id").distinct().count() == 3_500 and max(sizes[1:]) <= 60


def test_triples_order_drawn_users_only(spark, monkeypatch):
    """Twenty triples put twenty users' pairs in order, not all users'."""
    sizes, number = [], complement.numbered
    monkeypatch.setattr(complement, "numbered", lambda df, *o, **k: (sizes.append((k["name"], df.count())), number(df, *o, **k))[1])
    pairs = spark.range(9_000).selectExpr("id % 900 as user_id", "(id div 900) as item_id")
    got = complement.negative_triples(pairs, spark.range(50).withColumnRenamed("id", "item_id"), 20, 5).collect()
    assert len(got) == 20 and all(r.positive < 10 <= r.negative for r in got)
    assert max(n for name, n in sizes if name == "g") <= 200


@pytest.mark.parametrize("layers", [0, 1])
def test_training_takes_every_pair(spark, monkeypatch, layers):
    """More pairs than any fixed number of draws a step: each is a positive once an epoch, its negatives are unmet; rows of the loss's gradient by a single process."""
    met = [(u, i) for u in range(40) for i in range(25) if (u * 7 + i * 3) % 4 == 0] + [(99, i) for i in range(25)]
    seen, make = [], factors.pair_triples

    def counted(*p):
        for drawn in make(*p):
            seen.append([(r.user_id, r.positive, r.negative) for r in drawn.collect()])
            yield drawn

    monkeypatch.setattr(factors, "pair_triples", counted)
    pairs, items = spark.createDataFrame(met + met[:5], "user_id long, item_id long"), spark.range(25).withColumnRenamed("id", "item_id")
    first = {(r["side"], r["id"]): np.array(r["v"]) for r in factors.trained(pairs, items, dim=3, epochs=0, layers=0).collect()}
    got = {(r["side"], r["id"]): np.array(r["v"]) for r in factors.trained(pairs, items, dim=3, epochs=2, layers=layers, steps=1).collect()}
    open_ = [p for p in met if p[0] != 99]  # who has met everything has no triple
    assert len(seen) == 2 and seen[0] != seen[1]
    for triples in seen:
        assert sorted(t[:2] for t in triples) == sorted(open_) and not {(u, n) for u, _, n in triples} & set(met)
    if not layers:
        v, m, s = first, {n: 0.0 for n in first}, {n: 0.0 for n in first}
        for t, triples in enumerate(seen, 1):
            g = {}
            for u, p, n in triples:
                a, b, c = v["u", u], v["i", p], v["i", n]
                w = -1 / (1 + np.exp((b - c) @ a))
                for k, d in ((("u", u), w * (b - c) + 1e-4 * a), (("i", p), w * a + 1e-4 * b), (("i", n), -w * a + 1e-4 * c)):
                    g[k] = g.get(k, 0) + d / len(triples)
            m |= {k: 0.9 * m[k] + 0.1 * x for k, x in g.items()}
            s |= {k: 0.999 * s[k] + 0.001 * x * x for k, x in g.items()}
            v = v | {k: v[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8) for k in g}
        assert all(np.allclose(got[n], v[n], atol=1e-9) for n in first) and got.keys() == first.keys()


def test_scores_are_learned_from_all_pairs(spark, monkeypatch):
    """Both queries' training has as many triples an epoch as there are pairs of users who have unmet items."""
    sizes, make = [], factors.pair_triples

    def counted(pairs, *p):
        for drawn in make(pairs, *p):
            sizes.append((drawn.count(), pairs.count()))
            yield drawn

    monkeypatch.setattr(factors, "pair_triples", counted)
    from frostline import plans

    for name in ("mf_scores", "graph_scores"):
        assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert len(sizes) == 3 and all(n == of > 0 for n, of in sizes)
