"""Importance resampling against brute force, and the suffix array's runs against counted n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from conftest import SCHEMA, text

from frostline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def grams(words, n):
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, n=1, buckets=10_000, percent=10):
    feats = [(i, words_of(t), [zlib.crc32(g.encode()) % buckets for g in grams(words_of(t), n)]) for i, t in rows]
    s = Counter(b for _, _, f in feats for b in f)
    t = Counter(zlib.crc32(g.encode()) % buckets for x in target for g in grams(words_of(x), n))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, w, f in feats:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r, ranks.get(id(r))) for r in out]


KEY = lambda r: tuple((x is not None, x or 0) for x in r)


@pytest.mark.parametrize("n", [1, 3])
def test_against_brute_force(spark, docs, rows, n):
    target = [text(3, 200), None, "", text(77, 50).upper()]
    got = resampling.importance_sample(docs, spark.createDataFrame([(t, 1.0) for t in target], "text string, score double"), n=n, percent=30)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = brute([(r[0], r[1]) for r in rows], target, n, percent=30)
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(want, key=KEY) and any(r[5] for r in want)


def test_empty_tables_null_ids_and_ties(spark, empty):
    target = spark.createDataFrame([], "text string")
    assert resampling.importance_sample(empty, target).count() == 0
    rows = [(None, text(1, 30)), *[(5, text(2, 30))] * 12, (6, None), (7, "x " * 19)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0, 0.0, "") for i, t in rows], SCHEMA)
    got = resampling.importance_sample(docs, target).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(brute(rows, []), key=KEY)


def test_runs_of_the_suffix_array():
    """Every n-gram of a block is a run, hashed once, and stays inside its document."""
    texts = [resampling.plain_words(t) for t in ["a b a b a", "b a b", "", "a", "A-b A'b é1 é1"]]
    block = resampling.WordSuffixes(texts, 4)
    flat = [w.decode() for t in texts for w in t]
    for n in (1, 2, 3, 4):
        at, bucket = block.buckets(n, 2**32)
        found = Counter((" ".join(flat[i : i + n]), int(b)) for i, b in zip(at, bucket))
        want = Counter(" ".join(w.decode() for w in t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
        assert {g: c for (g, _), c in found.items()} == dict(want) and all(zlib.crc32(g.encode()) == b for g, b in found)
        runs = int((block.common < n)[block.left[block.order] >= n].sum())
        assert runs == len(want)
