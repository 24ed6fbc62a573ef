"""Near-duplicates and language-model scores against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from frostline.llm import components, language_model, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    ids = sorted({r[0] for r in rows})
    sets = {r[0]: shingles(r[1]) for r in rows}
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sets, {i: root(i) for i in ids}


def test_near_duplicates(docs, rows):
    sets, comp = brute_components(rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])
    assert comp[3] == comp[2] == 1 and comp[10] == 7


def test_near_duplicates_empty(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_families_beyond_the_pivot(spark):
    """A chain of copies, each alike only to its neighbours, and a family that is alike but not linked."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(12):  # every step changes some words for good
        for p in rng.choice(400, 6, replace=False):
            base[p] = f"c{k}_{p}"
        rows.append((k, " ".join(base)))
    other = [f"v{k}" for k in range(300)]
    for k in range(40):  # the same frame with 12 words of its own: about 0.7 alike
        own = list(other)
        for p in rng.choice(300, 12, replace=False):
            own[p] = f"o{k}_{p}"
        rows.append((100 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, comp = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == comp


def test_blocks_find_what_pivots_miss(spark):
    """The family step alone, with blocks smaller than the family."""
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:50] + [f"x{k}"] + base[51:])) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    families = docs.selectExpr("0L as family", "doc_id as node", "doc_id as component")
    links = near_dedup.family_links(families, docs, 5, 75, block=3)
    tied = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert tied == {k: 0 for k in range(9)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(20)]
    up = {n: n for e in links for n in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in linked}


def test_language_model(docs, rows):
    fold = {r[0]: zlib.crc32(str(r[0]).encode()) % 5 for r in rows}
    tokens = [(r[0], [*words(r[1]), ""]) for r in rows]
    train = [(i, t) for i, t in tokens if fold[i] != 1]
    c = Counter(w for _, t in train for w in t)
    n, v = sum(c.values()), len(c)
    got = defaultdict(list)
    for r in language_model.interpolated_scores(docs, most_chars=8000, bucket_bytes=4000).collect():
        got[r["doc_id"]].append(r)
    pair, ctx = Counter(), Counter()
    for _, t in train:
        for a, b in zip([" ", *t], t):
            pair[a, b] += 1
            ctx[a] += 1
    assert sum(map(len, got.values())) == len(rows)
    for i, t in tokens:
        r = got[i][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[i] == 1, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        # A mixture lies between the least and the greatest of its estimates.
        best = sum(math.log10(max(pair[a, b] / ctx[a] if ctx[a] else 0, c[b] / n, 1 / (v + 1))) for a, b in zip([" ", *t], t))
        assert r["score"] <= best + 1e-6
    every = [r for rs in got.values() for r in rs]
    assert sum(r["score"] for r in every) > sum(r["base_score"] for r in every)


def test_language_model_counts_and_units(docs):
    """Neither units nor buckets change a score."""
    one = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language_model.interpolated_scores(docs).collect()}
    two = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language_model.interpolated_scores(docs, most_chars=500, bucket_bytes=1000).collect()}
    assert one == pytest.approx(two)


def test_language_model_empty(empty):
    assert language_model.interpolated_scores(empty).count() == 0


def test_learned_weights():
    # One bucket where the bigram is always right, one where it never is.
    w = language_model.learn_weights([(1, 0, -10, 1000), (2, -999, -10, 1000)], 1e-6)
    assert w[1][0] > 0.95 and w[2][1] > 0.95 and w.sum(axis=1) == pytest.approx(np.ones(len(w)))
    assert language_model.learn_weights([], 0.5)[0] == pytest.approx([1 / 3] * 3)
