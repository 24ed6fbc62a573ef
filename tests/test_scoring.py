"""Scoring in chunks: broken and resumed runs, locks, three modes, hard numbers."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.operators import candidates, scoring
from frostline.sources.storage import new_path

def prompt():
    return F.concat(F.lit("p"), F.coalesce(F.col("k").cast("string"), F.lit("-")))


def examples(spark, n=1_000):
    return spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), (F.col("id") % 3).cast("string").alias("_label")).repartition(5)


def Fails(at=None, shift=0.0):  # noqa: N802
    """A scorer that fails at one prompt, and whose numbers are shifted; local classes travel to tasks whole."""

    class Shifted(scoring.HashScorer):
        def next_token(self, prompts):
            if at in prompts:
                raise RuntimeError("out of memory")
            return super().next_token(prompts) + [[0.0, shift]]

    return Shifted()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_broken_and_resumed_equals_one_run(spark):
    folder, ex = new_path(spark, "t"), examples(spark)
    whole = rows(scoring.scored(ex, prompt(), Fails(), "k", chunk_rows=90))
    assert len(whole) == 1_000 and len(whole[0]) == 5
    with pytest.raises(Exception, match="out of memory"):
        scoring.score_resumable(ex, prompt(), Fails("p555"), folder, "k", chunk_rows=90)
    ledger = scoring.Ledger(spark, folder)
    done = ledger.done()
    assert 555 // 90 not in done and not ledger.exists("lock")
    part = scoring.score_resumable(ex, prompt(), Fails("p555"), folder, "k", chunk_rows=90, most_chunks=0)
    assert part.count() == sum(min(90, 1_000 - 90 * c) for c in done)
    # What is there isn't scored again: a scorer that would give other numbers only fills the gaps.
    other = rows(scoring.score_resumable(ex, prompt(), Fails(shift=50.0), folder, "k", chunk_rows=90))
    assert [r[0] for r in other] == [r[0] for r in whole] and ledger.done() == list(range(12))
    assert all((a == b) if a[0] // 90 in done else b[3] == "1.000000" for a, b in zip(whole, other))


def test_early_ends_add_up(spark):
    folder, ex = new_path(spark, "t"), examples(spark)
    sizes = [scoring.score_resumable(ex, prompt(), Fails(), folder, "k", chunk_rows=100, most_chunks=m).count() for m in (2, 3, 0, 9, 9)]
    assert sizes == [200, 500, 500, 1_000, 1_000]
    assert rows(scoring.score_resumable(ex, prompt(), Fails("p1"), folder, "k", chunk_rows=100)) == rows(scoring.scored(ex, prompt(), Fails(), chunk_rows=64))


def test_two_runs_at_once_and_other_examples_are_refused(spark):
    folder, ex = new_path(spark, "t"), examples(spark, 50)
    ledger = scoring.Ledger(spark, folder)
    owner = ledger.lock()
    with pytest.raises(RuntimeError, match="locked by"):
        scoring.score_resumable(ex, prompt(), Fails(), folder)
    ledger.unlock("someone else")
    assert ledger.exists("lock")
    assert scoring.score_resumable(ex, prompt(), Fails(), folder, take_over=True).count() == 50
    ledger.unlock(owner)
    assert not ledger.exists("lock") and ledger.create("x", "a") and not ledger.create("x", "b") and ledger.read("x") == "a"
    for changed in ({"mode": "sequence"}, {"chunk_rows": 7}):
        with pytest.raises(ValueError, match="other examples or parameters"):
            scoring.score_resumable(ex, prompt(), Fails(), folder, **changed)
    with pytest.raises(ValueError, match="other examples"):
        scoring.score_resumable(ex.where("k > 3"), prompt(), Fails(), folder)


def test_modes_and_hard_numbers(spark):
    class Odd:
        def next_token(self, prompts):
            return np.array([[0.0, math.nan], [0.0, 800.0], [800.0, 0.0], [1.0, 1.0]])[: len(prompts)]

        def sequence(self, prompts):
            return np.array([[-np.inf, -np.inf], [-np.inf, -3.0], [-1.0, -np.inf], [-2.0, -2.0]])[: len(prompts)]

        def generate(self, prompts):
            return ["0.25", " 1 ", "1.5 stars", "it is 1.00!"][: len(prompts)]

    p = ["a"] * 4
    assert scoring.probabilities(Odd(), "next_token", p)[0] == [0.0, 1.0, 0.0, 0.5]
    assert scoring.probabilities(Odd(), "sequence", p)[0] == [0.0, 1.0, 0.0, 0.5]
    assert scoring.probabilities(Odd(), "generate", p, 0.1) == ([0.25, 1.0, 0.1, 1.0], ["0.25", " 1 ", "1.5 stars", "it is 1.00!"])
    with pytest.raises(ValueError, match="unknown mode"):
        scoring.probabilities(Odd(), "other", p)
    none = scoring.scored(spark.createDataFrame([(None, uuid.uuid4().hex), (None, "x")], "k long, text string"), F.lit(None).cast("string"), scoring.HashScorer(), mode="generate")
    assert none.count() == 2 and scoring.scored(none.limit(0).drop("prompt", "predict", "generation"), prompt(), scoring.HashScorer()).count() == 0


def test_score_rows_by_ranges_of_ids(spark):
    """Rows of a score matrix: sums in the order of components, columns by position, tasks by ranges of ids; no columns, no rows."""
    rng = np.random.default_rng(3)
    u, c = rng.normal(size=(700, 5)), rng.normal(size=(300, 5))
    users = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(u)], "id long, v array<double>")
    columns = spark.createDataFrame([(int(k), c[k].tolist()) for k in rng.permutation(len(c))], "pos long, v array<double>")
    found = candidates.score_rows(users.orderBy(F.rand(1)), columns, cells=30_000).withColumn("part", F.spark_partition_id())
    rows = found.collect()
    assert [r.id for r in rows] == [3 * i for i in range(700)] and len({r.part for r in rows}) >= 7
    for r in rows:
        want = np.zeros(len(c))
        for k in range(5):
            want = want + u[r.id // 3, k] * c[:, k]
        assert r.v == want.tolist()
    assert candidates.score_rows(users, columns.limit(0)).count() == 0
