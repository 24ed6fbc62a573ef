"""A head of two towers over stored vectors, trained on all rows by data-parallel steps.

Rows are stored once in a folder for each step of an epoch.  A step reads its own folder: every task adds up the
gradients of its rows at the weights it was sent, task sums are added up in a few groups, and the driver makes one
update of the weights, which are as large as the towers, however many rows there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.sources.storage import new_path

#: Sums of tasks meet in so many groups before the driver adds these.
GROUPS = 16


def initial_weights(n_u: int, n_i: int, hidden: int, out: int, seed: int) -> list[np.ndarray]:
    """Of each tower: weights and biases of both layers."""
    rng = np.random.default_rng(seed)
    w = []
    for n in (n_u, n_i):
        for a, b in ((n, hidden), (hidden, out)):
            w += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return w


def forward(w: list[np.ndarray], u: np.ndarray, i: np.ndarray):
    """Hidden and last outputs of both towers; the last ones' inner product is a pair's log odds."""
    hu, hi = np.maximum(u @ w[0] + w[1], 0), np.maximum(i @ w[4] + w[5], 0)
    return hu, hi, hu @ w[2] + w[3], hi @ w[6] + w[7]


def log_loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z) - y * z


def gradients(w: list[np.ndarray], u: np.ndarray, i: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Sums over rows of the soft log loss's derivatives, in the order of the weights."""
    hu, hi, a, b = forward(w, u, i)
    g = (1 / (1 + np.exp(-np.clip((a * b).sum(axis=1), -500, 500))) - y)[:, None]
    ga, gb = g * b, g * a
    du, di = (ga @ w[2].T) * (hu > 0), (gb @ w[6].T) * (hi > 0)
    return [u.T @ du, du.sum(axis=0), hu.T @ ga, ga.sum(axis=0), i.T @ di, di.sum(axis=0), hi.T @ gb, gb.sum(axis=0)]


class Adam:
    """Adam with decoupled decay and a rate that falls linearly to zero over all steps."""

    def __init__(self, w: list[np.ndarray], steps: int, rate: float, decay: float):
        self.w, self.steps, self.rate, self.decay, self.t = w, steps, rate, decay, 0
        self.m, self.s = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]

    def step(self, grads: list[np.ndarray]) -> None:
        rate = self.rate * (1 - self.t / self.steps)
        self.t += 1
        for x, g, m, s in zip(self.w, grads, self.m, self.s):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x *= 1 - rate * self.decay
            x -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)


def _flat(x: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in x])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    return [p.reshape(x.shape) for p, x in zip(np.split(flat, np.cumsum([x.size for x in like])[:-1]), like)]


def _summed(rows: DataFrame, w: list[np.ndarray], what, size: int) -> tuple[int, np.ndarray]:
    """(rows, sum of ``what``(w, u, i, y) of all batches): by task, then in ``GROUPS`` groups, then here."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        total, n = np.zeros(size), 0
        for batch in batches:
            u, i = (np.asarray(batch.column(c).flatten(), float).reshape(batch.num_rows, -1) for c in "ui")
            total += what(sent.value, u, i, batch.column("label").to_numpy().astype(float))
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.float64()))], ["n", "v"])

    def add(batches):
        total, n = np.zeros(size), 0
        for batch in batches:
            for m, v in zip(batch.column("n").to_pylist(), batch.column("v")):
                total, n = total + v.values.to_numpy(), n + m
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.float64()))], ["n", "v"])

    tasks = rows.select("u", "i", "label").mapInArrow(run, "n long, v array<double>")
    found = tasks.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS))).repartition(GROUPS, "g").select("n", "v").mapInArrow(add, "n long, v array<double>").collect()
    sent.unpersist()
    return sum(r.n for r in found), sum((np.array(r.v) for r in found if r.n), np.zeros(size))


def train(rows: DataFrame, hidden: int = 16, out: int = 8, epochs: int = 8, steps: int = 4, rate: float = 3e-2, decay: float = 1e-5, seed: int = 5) -> tuple[list[np.ndarray], list[tuple[int, float, float, bool]]]:
    """(weights, report) of ``rows`` (u, i: vectors, label in 0..1, share in 0..1); shares from 0.8 on are held out.

    An epoch makes ``steps`` updates, each from the mean gradient of its part of all training rows; a row's part is
    drawn by its share's hash, the order of the parts anew each epoch.  The report has each epoch's held-out loss and
    accuracy at 0.5; the weights are those of the most accurate epoch, the first of equals.
    """
    part = F.when(F.col("share") >= 0.8, -1).otherwise(F.pmod(F.xxhash64(F.lit(seed), "share"), F.lit(steps)).cast("int"))
    folder = new_path(rows.sparkSession, "towers")
    floats = [F.col(c).cast("array<float>").alias(c) for c in "ui"]
    rows.select(*floats, F.col("label").cast("double").alias("label"), part.alias("part")).write.partitionBy("part").parquet(folder)
    stored = rows.sparkSession.read.schema("u array<float>, i array<float>, label double, part int").parquet(folder)
    first = stored.select(F.size("u").alias("u"), F.size("i").alias("i")).first()
    if first is None:
        return [], []
    w = initial_weights(first.u, first.i, hidden, out, seed)
    adam, rng, size = Adam(w, epochs * steps, rate, decay), np.random.default_rng(seed + 1), sum(x.size for x in w)

    def held(w, u, i, y):
        _, _, a, b = forward(w, u, i)
        z = (a * b).sum(axis=1)
        return np.array([log_loss(z, y).sum(), ((z > 0) == (y > 0.5)).sum()])

    best, report = None, []
    for epoch in range(epochs):
        for k in rng.permutation(steps).tolist():
            n, total = _summed(stored.where(F.col("part") == k), adam.w, lambda w, u, i, y: _flat(gradients(w, u, i, y)), size)
            if n:
                adam.step(_shaped(total / n, adam.w))
        n, (loss, right) = _summed(stored.where("part = -1"), adam.w, held, 2)
        report.append((epoch, loss / max(n, 1), right / max(n, 1)))
        if best is None or report[-1][2] > best[0]:
            best = report[-1][2], epoch, [x.copy() for x in adam.w]
    return best[2], [(e, float(x), float(a), e == best[1]) for e, x, a in report]
