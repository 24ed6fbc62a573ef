"""Scores of the language model against a plain mixture with the same weights; executors that come between its passes."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SCHEMA, text

from frostline.llm import language_model


def words(t):
    return [*(t or "").encode().lower().split(), b""]


def plain_scores(rows):
    """Deleted interpolation in dictionaries: counts without fold 0 meet its tokens, weights by EM in context buckets."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    train, deleted = ([words(t) for i, t in rows if keep(fold(i))] for keep in (lambda f: f != 1, lambda f: f == 0))

    def counts(docs):
        word, pair = Counter(), Counter()
        for d in docs:
            word.update(d)
            word[b" "] += 1  # the start, as a context only
            pair.update(zip([b" ", *d], d))
        return word, pair

    (word, pair), (dw, dp) = counts(train), counts(deleted)
    v, n = len(set(word) - {b" "}), sum(c for w, c in word.items() if w != b" ")
    m = sum(c for w, c in dw.items() if w != b" ")

    def estimates(d, word, pair, n):
        for a, b in zip([b" ", *d], d):
            c = word[a]
            yield math.frexp(c)[1], pair[a, b] / c if c else 0.0, (word[b] if b != b" " else 0) / max(n, 1)

    less = lambda a, b: Counter({k: a[k] - b[k] for k in a})
    held = Counter()
    for d in deleted:
        for bucket, p2, p1 in estimates(d, less(word, dw), less(pair, dp), n - m):
            q = [language_model._NONE if p == 0 else round(2 * math.log2(p)) for p in (p2, p1)]
            held[bucket, q[0], q[1]] += 1
    uniform = 1 / (v + 1)
    by = defaultdict(list)
    for (bucket, q2, q1), c in held.items():
        by[bucket].append(([0 if q == language_model._NONE else 2.0 ** (q / 2) for q in (q2, q1)] + [uniform], c))

    def em(rows, w, prior):
        for _ in range(40):
            sums = list(prior)
            for p, c in rows:
                z = sum(x * y for x, y in zip(p, w))
                for k in range(3):
                    sums[k] += c * p[k] * w[k] / z
            w = [x / sum(sums) for x in sums]
        return w

    every = em([r for rs in by.values() for r in rs], [1 / 3] * 3, [0, 0, 0]) if held else [1 / 3] * 3
    every = [max(x, 1e-9) for x in every]
    every = [x / sum(every) for x in every]
    weights = defaultdict(lambda: every, {b: em(rs, every, every) for b, rs in by.items()})
    zero = [0.0, *weights[0][1:]]
    weights[0] = [x / sum(zero) for x in zero]
    return [sum(math.log10(weights[b][0] * p2 + weights[b][1] * p1 + weights[b][2] * uniform) for b, p2, p1 in estimates(words(t), word, pair, n)) for _, t in rows]


def test_scores_by_brute_force(spark):
    rows = [(i, text(i % 23, 5 + 7 * (i % 31))) for i in range(150)] + [(200, None), (201, ""), (202, "never seen words here"), (None, text(3, 50)), (7, text(90, 40)), (7, text(90, 40))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0, 0.0, "") for i, t in rows], SCHEMA)
    got = language_model.interpolated_scores(docs, most_chars=3_000, bucket_bytes=5_000).collect()
    want = plain_scores(rows)
    key = lambda i, n, s: ((i is not None, i or 0), n, round(s, 6))
    assert sorted(key(r.doc_id, r.n_tokens, r.score) for r in got) == sorted(key(i, len(words(t)), s) for (i, t), s in zip(rows, want))


def test_passes_agree_when_executors_come(spark, tmp_path, monkeypatch):
    """The parallelism that Spark cuts tables by changes between the passes; units stay as they were."""
    path = str(tmp_path / "d")
    spark.range(1_000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 300), k -> concat('w', (k * 7 + id) % 97))) as text").coalesce(1).write.option("parquet.block.size", 4_096).option("parquet.page.size.row.check.min", 1).parquet(path)
    setting, learn = "spark.sql.leafNodeDefaultParallelism", language_model.learn_weights

    def more(*args):
        spark.conf.set(setting, "9")
        return learn(*args)

    monkeypatch.setattr(language_model, "learn_weights", more)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set(setting, "2")
    try:
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() == 2
        got = language_model.interpolated_scores(docs, stored=True, most_chars=100_000)
        assert got.count() == 1_000 and np.isfinite([r.score for r in got.collect()]).all()
        assert spark.read.parquet(path).rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset(setting)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


@pytest.mark.parametrize("name", ["spark.sql.files.minPartitionNum"])
def test_own_setting_stays(spark, name):
    from frostline.llm.common import same_splits

    spark.conf.set(name, "3")
    try:
        with same_splits(spark):
            assert spark.conf.get(name) == "3"
        assert spark.conf.get(name) == "3"
    finally:
        spark.conf.unset(name)
