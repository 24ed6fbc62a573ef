"""Data-parallel towers against one process, projections and pooling against plain sums, ridge on projected texts."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline import plans
from frostline.operators import models, towers
from frostline.plans import base

SF = "/root/testdata/sf0.001"


def test_towers_equal_one_process(spark):
    rng = np.random.default_rng(3)
    u, i = rng.normal(size=(600, 6)).astype("f4"), rng.normal(size=(600, 5)).astype("f4")
    y = 1 / (1 + np.exp(-3 * u[:, 0] * i[:, 1]))
    share = (np.arange(600) * 0.6180339887) % 1
    frame = spark.createDataFrame([(a.tolist(), b.tolist(), float(c), float(s)) for a, b, c, s in zip(u, i, y, share)], "u array<double>, i array<double>, label double, share double").repartition(7)
    got, report = towers.train(frame, 8, 4, 6, 3, rate=0.05, seed=9)
    part = {r.share: r.k for r in frame.select("share", F.pmod(F.xxhash64(F.lit(9), "share"), F.lit(3)).alias("k")).collect()}
    parts = np.array([-1 if s >= 0.8 else part[float(s)] for s in share])

    w = towers.initial_weights(6, 5, 8, 4, 9)
    adam, order, want, best = towers.Adam(w, 18, 0.05, 1e-5), np.random.default_rng(10), [], None
    for epoch in range(6):
        for k in order.permutation(3).tolist():
            on = parts == k
            adam.step([g / on.sum() for g in towers.gradients(adam.w, u[on].astype(float), i[on].astype(float), y[on])])
        out = parts == -1
        z = np.prod(towers.forward(adam.w, u[out].astype(float), i[out].astype(float))[2:], axis=0).sum(axis=1)
        want.append((float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y[out] * z)), float(((z > 0) == (y[out] > 0.5)).mean())))
        if best is None or want[-1][1] > best[0]:
            best = want[-1][1], epoch, [x.copy() for x in adam.w]
    assert [(e, b) for e, _, _, b in report] == [(e, e == best[1]) for e in range(6)]
    assert np.allclose([r[1:3] for r in report], want) and all(np.allclose(a, b) for a, b in zip(got, best[2]))
    assert report[-1][1] < report[0][1] and best[0] > 0.7
    assert towers.train(frame.limit(0)) == ([], [])


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    w, u, i, y = towers.initial_weights(3, 4, 5, 2, 1), rng.normal(size=(20, 3)), rng.normal(size=(20, 4)), rng.random(20)
    loss = lambda: towers.log_loss(np.prod(towers.forward(w, u, i)[2:], axis=0).sum(axis=1), y).sum()
    for x, g in zip(w, towers.gradients(w, u, i, y)):
        at = tuple(0 for _ in x.shape)
        x[at] += 1e-6
        up = loss()
        x[at] -= 2e-6
        assert g[at] == pytest.approx((up - loss()) / 2e-6, abs=1e-4)
        x[at] += 1e-6


def normal(term, k, dim, seed):
    h = hashlib.md5(f"{seed}:{term}-{k}".encode()).hexdigest()
    return math.sqrt(-2 * math.log((int(h[:8], 16) + 0.5) / 2**32)) * math.cos(2 * math.pi * int(h[8:16], 16) / 2**32) / math.sqrt(dim)


def test_projection_by_brute_force(spark):
    rows = [(i % 40, f"t{(i * i) % 97}", float(i % 7 - 3)) for i in range(900)] + [(50, None, 1.0), (None, "t1", 1.0), (51, "t1", 0.0), (52, "é", 2.0)]
    for most in (5, 20_000):
        got = {r.id: r.v for r in models.projected(spark.createDataFrame(rows, "id long, term string, weight double").repartition(5), 12, 4, most).collect()}
        want = defaultdict(lambda: np.zeros(12))
        for i, t, w in rows:
            if i is not None and t is not None and w:
                want[i] = want[i] + w * np.array([normal(t, k, 12, 4) for k in range(12)])
        assert set(got) == set(want) and all(np.allclose(got[i], v / np.linalg.norm(v)) for i, v in want.items())
    x = models.gaussian_rows([f"w{k}" for k in range(400)], 64, 1) * 8
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02  # entries of variance 1 / dim


def test_pooling(spark):
    rows = [(i, p, int((i + p) % 3 > 0), [float(i), float(p)]) for i in range(5) for p in range(0, 200, 3)] + [(9, 0, 0, [1.0, 1.0]), (10, 500, 1, [1.0, 2.0]), (11, 2, None, [3.0, 3.0]), (11, 1, 1, [4.0, 4.0])]
    frame = spark.createDataFrame(rows, "id long, pos long, mask int, v array<double>")
    mean, last = ({r.id: r.v for r in models.pooled(frame, m).collect()} for m in ("mean", "last"))
    on = defaultdict(list)
    for i, p, m, v in rows:
        if p < 128 and m:
            on[i].append((p, v))
    assert set(mean) == {0, 1, 2, 3, 4, 9, 11} and mean[9] == [0.0, 0.0]
    assert all(np.allclose(mean[i], np.mean([v for _, v in vs], axis=0)) and last[i] == max(vs)[1] for i, vs in on.items()) and set(last) == set(on)
    with pytest.raises(ValueError):
        models.pooled(frame, "first")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_cand_ridge_by_brute_force(spark):
    from frostline.plans import pools

    users, items, train = pools._fresh(spark, SF)
    users, ids, train = {r.id: np.array(r.v) for r in users.collect()}, {r.id for r in items.collect()}, [tuple(r) for r in train.select("user_id", "item_id").collect()]
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_type").collect()
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    content = {}
    for k, name, kind in parts:
        words = Counter(w for w in re.split(r"[^\w]+", f"{name} {kind}".lower()) if len(w) >= 2)
        if k in ids and words:
            content[k] = unit(sum(c * np.array([normal(w, j, 32, "ridge") for j in range(32)]) for w, c in words.items()))
    met, vectors = defaultdict(list), {r.id: np.array(r.v) for r in base.user_vectors(spark, SF).collect()}
    for u, i in train:
        if i in content:
            met[u].append(content[i])
    known = sorted(set(met) & set(vectors))
    x = np.column_stack([[vectors[u] for u in known], np.ones(len(known))])
    y = np.array([unit(np.mean(met[u], axis=0)) for u in known])
    w = np.linalg.solve(x.T @ x + 10 * np.diag([1.0] * (x.shape[1] - 1) + [0.0]), x.T @ y)
    got = defaultdict(dict)
    for r in plans.QUERIES["cand_ridge"](spark, SF).collect():
        got[r.user_id][r.item_id] = r.probability
    seen = set(train)
    assert set(got) == set(users)
    for u, v in users.items():
        z = unit(np.append(v, 1) @ w)
        scores = {i: float(z @ c) for i, c in content.items() if (u, i) not in seen}
        best = sorted(scores.values(), reverse=True)[:20]
        assert len(got[u]) == len(best) and sorted((scores[i] for i in got[u]), reverse=True) == pytest.approx(best, abs=1e-6)
        span = best[0] - best[-1]
        assert all(p == pytest.approx(0.2 + 0.7 * (scores[i] - best[-1]) / span, abs=1e-4) for i, p in got[u].items())
