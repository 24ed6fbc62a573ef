"""Reranking by logistic regression, all entity types fitted in the same passes.

A pass adds up each type's loss, gradient and second derivatives where the rows lie; what reaches the
driver is (d + 1) * (d + 2) + 1 numbers a type, however many rows there are.  Newton steps of all types are then
solved at once, and halved for a type whose loss rose.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.operators.ids import HashOrder, hash_order
from frostline.sources.storage import stored

KEYS = ["user_id", "item_id", "entity_type"]
FEATURES = ["scaled", "rank_share", "inverse_rank", "to_best", "z", "gap_before", "gap_after", "gap_best", "popular"]
MODES = ("logreg", "rerank", "scaled")


def training_rows(rows: DataFrame, multiplier: int = 30, least: int = 50_000, seed: int | str = 42) -> DataFrame:
    """``rows`` (entity_type, label 0 or 1, ...) that a fit learns from, with balanced ``weight``s.

    All positives of a type and, of its negatives, ``multiplier`` times as many but at least ``least``: those of
    smallest hash.  A type's weights give both classes the same sum.  Counts by hash tell where a type's negatives are cut
    (``HashOrder``), so no row is sent anywhere; where no type has too many, stored rows are not stored again.
    """
    rows = rows if getattr(rows, "_stored_at", None) else stored(rows)
    key, positive = hash_order(F.concat_ws("-", "user_id", "item_id"), seed), F.col("label") == 1
    kept, weight, cut = F.lit(False), F.lit(None).cast("double"), False
    sizes = rows.where("entity_type is not null").groupBy("entity_type").agg(F.count_if(positive).alias("p"), F.count("*").alias("n")).collect()
    for kind, p, n in sorted(map(tuple, sizes)):
        most, mine, of = max(least, p * multiplier), F.col("entity_type") == kind, positive
        if n - p > most:
            cut = True
            (first,) = HashOrder(rows.where(mine & ~positive), key, "user_id", "item_id").first(most)
            of = positive | first
        m = min(n - p, most)
        kept = kept | (mine & of if n - p > most else mine)
        weight = F.when(mine, F.when(positive, (p + m) / 2 / max(p, 1)).otherwise((p + m) / 2 / max(m, 1))).otherwise(weight)
    train = rows.where(kept).withColumn("weight", weight)
    return stored(train) if cut else train


@dataclass
class Fit:
    """One type's model: ``weights`` (the last one is the bias) of features less ``mean`` over ``sd``."""

    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    loss: float
    rounds: int


def fit_all(train: DataFrame, columns: list[str], penalty: float = 1.0, rounds: int = 50, tolerance: float = 1e-10) -> dict[str, Fit]:
    """Balanced logistic regressions of label on standardised columns by entity type, to the least penalised loss.

    The loss is sum(weight * log loss) + penalty / 2 * |w|^2 without the bias.  A type without both classes has no
    fit.  Types are few: the driver holds a small matrix for each.
    """
    d = len(columns)
    stats = train.groupBy("entity_type").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))], F.countDistinct("label").alias("classes")).collect()
    fits = {}
    for r in stats:
        if r.classes == 2:
            sd = np.array([r[f"sd_{c}"] for c in columns], float)
            fits[r.entity_type] = Fit(np.array([r[f"mean_{c}"] for c in columns], float), np.where(sd > 0, sd, 1.0), np.zeros(d + 1), np.inf, 0)
    last = {k: (f.weights, np.zeros(d + 1)) for k, f in fits.items()}  # where a type came from, and its step
    open_ = set(fits)
    ready = train.select(F.col("entity_type").alias("kind"), F.col("label").cast("double").alias("y"), F.col("weight").cast("double").alias("w"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    for _ in range(rounds):
        if not open_:
            break
        sums = _pass(ready.where(F.col("kind").isin(*open_)), {k: fits[k] for k in open_}, d)
        for k in list(open_):
            f, (before, step) = fits[k], last[k]
            total = sums[k]
            loss = total[0] + penalty / 2 * float(f.weights[:-1] @ f.weights[:-1])
            f.rounds += 1
            if loss > f.loss * (1 + 1e-12) and np.abs(step).max() > tolerance:
                last[k] = (before, step / 2)
                f.weights = before + step / 2
                continue
            f.loss = loss
            ridge = np.append(np.full(d, penalty), 0.0)
            gradient, hessian = total[1 : d + 2] + ridge * f.weights, total[d + 2 :].reshape(d + 1, d + 1) + np.diag(ridge)
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            last[k] = (f.weights, step)
            if np.abs(step).max() <= tolerance:
                open_.discard(k)
            f.weights = f.weights + step
    return fits


def _pass(ready: DataFrame, fits: dict[str, Fit], d: int) -> dict[str, np.ndarray]:
    """By kind: loss, gradient and second derivatives (row by row) at the fits' weights."""
    n = 1 + (d + 1) + (d + 1) ** 2

    def add(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, d)
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            for kind, f in fits.items():
                at = np.flatnonzero(kinds == kind)
                if not len(at):
                    continue
                a = np.column_stack([(x[at] - f.mean) / f.sd, np.ones(len(at))])
                z = a @ f.weights
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = w[at] @ (np.logaddexp(0, z) - y[at] * z)
                part = np.concatenate([[loss], a.T @ (w[at] * (p - y[at])), ((a * (w[at] * p * (1 - p))[:, None]).T @ a).ravel()])
                total[kind] = total.get(kind, 0.0) + part
        for kind, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array(range(n), pa.int32()), pa.array(t)], ["kind", "k", "v"])

    out = {k: np.zeros(n) for k in fits}
    for r in ready.mapInArrow(add, "kind string, k int, v double").groupBy("kind", "k").agg(F.sum("v").alias("v")).collect():
        out[r.kind][r.k] = r.v
    return out


def probability(fits: dict[str, Fit], columns: list[str]) -> Column:
    """A row's probability by its type's fit, in expressions of columns; null for a type without one."""
    out = F.lit(None).cast("double")
    for kind, f in sorted(fits.items()):
        z = F.lit(float(f.weights[-1]))
        for c, m, s, w in zip(columns, f.mean, f.sd, f.weights):
            z = z + (F.col(c) - F.lit(float(m))) * F.lit(float(w / s))
        out = F.when(F.col("entity_type") == kind, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def reranked(features: DataFrame, labels: DataFrame | None, columns: list[str] | None = None, budgets: dict[str, int] | None = None, default: int | None = None, share: float = 0.5, mode: str = "logreg", **training) -> DataFrame:
    """(user_id, item_id, entity_type, probability, rerank, logreg, scaled): each user's best by calibrated scores.

    ``features``: keys, ``scaled`` and the other columns; ``labels``: keys of the positives of validation, or None
    where the features' rows have a ``label`` already.  ``rerank``
    is (1 - share) * scaled + share * logreg, clipped; by it, then by scaled and item, a user keeps as many as the type's
    budget (all without one).  ``probability`` is what ``mode`` names.  A type without both classes keeps ``scaled``
    as its logreg.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    columns = columns or FEATURES
    rows = features.select(*KEYS, *dict.fromkeys(["scaled", *columns]), *(["label"] if labels is None else []))
    if labels is not None:
        rows = rows.join(labels.select(*KEYS).distinct().withColumn("label", F.lit(1)), KEYS, "left")
    rows = stored(rows.withColumn("label", F.coalesce("label", F.lit(0))))
    fits = fit_all(training_rows(rows, **training), columns)
    scores = rows.withColumn("logreg", F.coalesce(probability(fits, columns), F.col("scaled")))
    scores = scores.withColumn("rerank", F.least(F.greatest((1 - share) * F.col("scaled") + share * F.col("logreg"), F.lit(0.0)), F.lit(1.0)))
    if budgets is not None or default is not None:
        limit = F.lit(default)
        for kind, k in (budgets or {}).items():
            limit = F.when(F.col("entity_type") == kind, k).otherwise(limit)
        place = F.row_number().over(Window.partitionBy("entity_type", "user_id").orderBy(F.col("rerank").desc(), F.col("scaled").desc(), "item_id"))
        scores = scores.withColumn("_place", place).where(limit.isNull() | (F.col("_place") <= limit))
    return scores.select(*KEYS, F.col(mode).alias("probability"), "rerank", "logreg", "scaled")
