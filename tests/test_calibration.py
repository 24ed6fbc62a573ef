"""Logistic regressions of all entity types in one pass, against plain Newton steps on each type's rows."""

import numpy as np
import pytest

from frostline.operators import calibration

COLUMNS = ["scaled", "a", "b"]


def plain(x, y, w, penalty=1.0):
    """The least penalised loss by many damped gradient steps with the exact second derivatives."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    a = np.column_stack([(x - mean) / np.where(sd > 0, sd, 1.0), np.ones(len(x))])
    ridge, v = np.append(np.full(x.shape[1], penalty), 0.0), np.zeros(x.shape[1] + 1)
    loss = lambda v: w @ (np.logaddexp(0, a @ v) - y * (a @ v)) + ridge @ (v * v) / 2
    for _ in range(300):
        p = 1 / (1 + np.exp(-(a @ v)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(ridge) + 1e-12 * np.eye(len(v)), a.T @ (w * (p - y)) + ridge * v)
        t = 1.0
        while loss(v - t * step) > loss(v) + 1e-12 and t > 1e-8:
            t /= 2
        v = v - t * step
    return 1 / (1 + np.exp(-(a @ v))), v


@pytest.fixture(scope="module")
def data():
    rng, rows = np.random.default_rng(1), []
    for kind, n, shift in (("strict_cold", 400, 0.3), ("warmup", 150, -0.5), ("one_class", 20, None), ("flat", 30, 0.0)):
        for i in range(n):
            s, a = rng.random(), rng.normal()
            b = 0.0 if kind == "flat" else rng.normal() * 5 + 2
            label = 0 if shift is None else int(rng.random() < 1 / (1 + np.exp(-(2 * s + a - 0.3 * b + shift))))
            rows.append((i % 12, i, kind, float(s), float(a), float(b), label))
    return rows


def test_fits_by_brute_force(spark, data):
    frame = spark.createDataFrame(data, "user_id long, item_id long, entity_type string, scaled double, a double, b double, label int")
    train = calibration.training_rows(frame, multiplier=1, least=0)
    fits = calibration.fit_all(train, COLUMNS)
    assert set(fits) == {"strict_cold", "warmup", "flat"} and all(f.rounds < 20 for f in fits.values())
    rows = [tuple(r) for r in train.select("entity_type", *COLUMNS, "label", "weight").collect()]
    for kind, f in fits.items():
        mine = [r for r in rows if r[0] == kind]
        x, y, w = np.array([r[1:4] for r in mine], float), np.array([r[4] for r in mine], float), np.array([r[5] for r in mine])
        assert y.sum() == sum(r[6] for r in data if r[2] == kind) and len(y) == min(2 * y.sum(), sum(r[2] == kind for r in data))
        assert abs(w[y == 1].sum() - w[y == 0].sum()) < 1e-9 and abs(w.sum() - len(y)) < 1e-9
        p, v = plain(x, y, w)
        assert np.abs(v - f.weights).max() < 1e-6
        got = calibration.probability(fits, COLUMNS)
        found = sorted(r[0] for r in train.where(f"entity_type = '{kind}'").select(got).collect())
        assert np.abs(np.sort(p) - found).max() < 1e-6


def test_separable_and_steep_rows_converge(spark):
    rows = [(0, i, "k", float(i), 1000.0 * i, 0.0, int(i > 9)) for i in range(20)]
    fits = calibration.fit_all(spark.createDataFrame(rows, "user_id long, item_id long, entity_type string, scaled double, a double, b double, label int").selectExpr("*", "1.0D as weight"), COLUMNS)
    x, y = np.array([r[3:6] for r in rows]), np.array([r[6] for r in rows], float)
    assert np.abs(plain(x, y, np.ones(20))[1] - fits["k"].weights).max() < 1e-5


def test_modes_budgets_and_hard_rows(spark, data):
    frame = spark.createDataFrame([r[:6] for r in data], "user_id long, item_id long, entity_type string, scaled double, a double, b double")
    labels = spark.createDataFrame([r[:3] for r in data if r[6]] * 2 + [(999, 999, "warmup")], "user_id long, item_id long, entity_type string")
    every = {m: {tuple(r)[:3]: r for r in calibration.reranked(frame, labels, COLUMNS, mode=m, share=0.25, least=100).collect()} for m in calibration.MODES}
    assert all(len(v) == len(data) for v in every.values())
    for k, r in every["rerank"].items():
        assert abs(r.rerank - min(max(0.75 * r.scaled + 0.25 * r.logreg, 0), 1)) < 1e-12 and r.probability == r.rerank
        assert every["logreg"][k].probability == pytest.approx(r.logreg, abs=1e-9) and every["scaled"][k].probability == r.scaled
        if k[2] == "one_class":
            assert r.logreg == r.scaled
    got = calibration.reranked(frame, labels, COLUMNS, {"strict_cold": 3}, 2, least=100).collect()
    full = calibration.reranked(frame, labels, COLUMNS, least=100).collect()
    for kind, k in (("strict_cold", 3), ("warmup", 2)):
        for u in range(12):
            want = sorted((r for r in full if r.entity_type == kind and r.user_id == u), key=lambda r: (-r.rerank, -r.scaled, r.item_id))[:k]
            assert sorted(r.item_id for r in got if r.entity_type == kind and r.user_id == u) == sorted(r.item_id for r in want)
    assert calibration.reranked(frame.limit(0), labels, COLUMNS).count() == 0
    with pytest.raises(ValueError):
        calibration.reranked(frame, labels, COLUMNS, mode="x")
