"""Token files, packing and the source mix: exact round trips and brute force."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import text
from tokenizers import Tokenizer

from frostline.llm import common, mixing, packing, token_files


def reference_ids(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files(docs, rows):
    got = sorted(map(tuple, token_files.token_file_digest(docs, public_tokenizers.path("word_bpe_49k.json")).collect()))
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    at, want = 0, []
    for r, ids in zip(ordered, reference_ids("word_bpe_49k.json", [r[1] for r in ordered], 2)):
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_token_files_empty(empty):
    assert token_files.token_file_digest(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_files_are_flat(spark, docs, rows):
    """The files alone give the ids back: 16 bits each here, offsets of 64 bits."""
    folder = common.new_folder(spark, "flat")
    manifest = token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder).collect()
    n = 0
    for m in manifest:
        path = folder.removeprefix("file://").removeprefix("file:")
        ids, idx = np.memmap(f"{path}/{m['name']}.bin", "<u2", "r"), np.memmap(f"{path}/{m['name']}.idx", "<u8", "r")
        assert len(idx) == m["n_docs"] + 1 and idx[-1] == len(ids) == m["n_tokens"]
        assert all(ids[int(e) - 1] == 2 for e in idx[1:])
        n += m["n_docs"]
    assert n == len(rows)


def check_packing(got, want, capacity):
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["piece"]].append(r)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= capacity
    assert sum(len(v) for v in pieces.values()) == sum(-(-len(ids) // capacity) for _, ids in want)
    for doc, ids in want:
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            r = pieces[doc, k][0]
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    return len(sequences)


def test_packing(docs, rows):
    want = list(zip([r[0] for r in rows], reference_ids("byte_bpe_50k.json", [r[1] for r in rows], 0)))
    for capacity in (64, 2048):
        got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity).collect()
        n = check_packing(got, want, capacity)
        assert n <= 1.1 * -(-sum(len(i) for _, i in want) // capacity) + 1


def test_packing_empty(empty):
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("low,high,n", [(1, 2048, 4000), (500, 1000, 3000), (600, 1400, 5000), (1, 40, 3000), (2048, 2048, 7)])
def test_plan_places_every_piece_once(low, high, n):
    rng = np.random.default_rng(n)
    lengths = rng.integers(low, high + 1, n)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    p = packing.plan(dict(histogram), 2048)
    used = np.zeros(p["sequences"], int)
    ranks = defaultdict(int)
    rows = sorted(zip(p["size"], p["rank"], p["each"], p["first"], p["offset"]))
    for k, (size, rank, each, first, offset) in enumerate(rows):
        assert ranks[size] == rank
        end = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == size else histogram[size]
        assert (end - rank) % each == 0
        used[first : first + (end - rank) // each] += each * size
        ranks[size] = end
    assert ranks == histogram and used.max() <= 2048 and (used > 0).all()
    plain = sum(k for _, k in packing.best_fit(np.array(sorted(histogram)), np.array([histogram[s] for s in sorted(histogram)]), 2048))
    assert p["sequences"] <= plain * 1.005 + 1


def test_price_is_the_best_knapsack():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 30), 6, replace=False))
        value = rng.random(6)
        best = np.zeros(41)
        for c in range(1, 41):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes, value) if s <= c)])
        used = packing.price(sizes, value, 40)
        assert used @ sizes <= 40 and used @ value == pytest.approx(best[40])


def water_filled(sizes, weights, most=3):
    """Targets by sharing again, as the rule says."""
    total, capped, target = sum(sizes), {}, {}
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        left = total - sum(capped.values())
        target = {k: left * weights[k] / sum(weights[f] for f in free) for k in free}
        over = [k for k in free if target[k] > most * sizes[k]]
        if not over:
            return [capped.get(k, target.get(k)) for k in range(len(sizes))]
        capped |= {k: most * sizes[k] for k in over}


def test_mix(docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    sizes = [sum(size(r[1]) for r in rows if r[3] == s) for s in sources]
    want = dict(zip(sources, water_filled(sizes, [(5, 2, 1)[k % 3] for k in range(len(sources))])))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[sources.index(s)] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sources:
        assert abs(taken[s] - want[s]) <= 3 * mixing.LEAST_BLOCK
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs).collect()))


def test_mixed_documents_hold_what_is_taken(docs):
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    held = defaultdict(int)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        held[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert held == {k: v for k, v in taken.items() if v}


def test_mixed_documents_are_whole(spark):
    """Sources above and below their targets; line breaks and the words between stay."""
    rows = [(100 * k + j, text(9 * k + j, 20 + 7 * j) + "\n\n" + text(j, 5), f"s{k}") for k in range(6) for j in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = {i: t for i, t, _ in rows}
    out = mixing.mixed_documents(docs).collect()
    assert out and all(r["text"] == known[r["doc_id"]] for r in out)
    by = defaultdict(int)
    for r in mixing.mix(docs).collect():
        by[r["source"], r["target"]] += r["taken"]
    assert any(t < 30 * 100 for _, t in by) and all(abs(n - t) <= 24 for (_, t), n in by.items())


def test_small_source_beside_a_huge_one(spark):
    """Some 9 million words more leave a small source its target; copies are dealt to shards by quota."""
    rows = [(j, text(j, 10 + j % 9), "tiny") for j in range(40)]
    huge = spark.range(1000, 1300).selectExpr("id as doc_id", "repeat('word ', 30000) as text", "'huge' as source")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").union(huge)
    got = [r for r in mixing.mix(docs, shards=4).collect() if r["source"] == "tiny"]
    size, target = got[0]["source_size"], got[0]["target"]
    assert target == 3 * size and sum(r["taken"] for r in got) == target
    dealt = defaultdict(int)
    for r in got:
        assert len(r["shards"]) == r["times"]
        for s in r["shards"]:
            dealt[s] += r["size"]
    assert set(dealt) == {1, 2, 3, 4} and all(abs(n - target / 4) <= 2 * 20 for n in dealt.values())


def test_mix_empty(spark, empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).agg({"taken": "sum"}).first()[0] == 0


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    """Seats by comparing all quotients, one by one."""
    rng = np.random.default_rng(seed)
    targets = {f"s{k:02d}": float(x) for k, x in enumerate(rng.random(9) ** 3 * 100 + 0.01)}
    houses = {1: 1, 2: 17, 3: 240}
    t = spark.createDataFrame(list(targets.items()), "source string, target double")
    got = defaultdict(dict)
    for r in mixing.apportion(t, list(houses.items())).collect():
        got[r["shard"]][r["source"]] = r["seats"]
    for shard, house in houses.items():
        seats = dict.fromkeys(targets, 0)
        for _ in range(house):
            best = min(targets, key=lambda s: (-targets[s] / (2 * seats[s] + 1), s))
            seats[best] += 1
        assert got[shard] == seats


def many(spark):
    rows = [(1_000 * k + j, text(31 * k + j, 5 + (j * 7) % 60), f"s{k}") for k in range(4) for j in range(400 if k else 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_seeds_and_shards_change_the_choice_not_the_totals(spark):
    docs = many(spark)
    taken = {}
    for shards, seed in ((16, 17), (4, 17), (16, 18)):
        got = mixing.mix(docs, shards=shards, seed=seed).collect()
        taken[shards, seed] = {r["doc_id"]: r["times"] for r in got}
        by = defaultdict(int)
        for r in got:
            by[r["source"], r["target"]] += r["taken"]
            assert len(r["shards"]) == r["times"] <= 3 and all(1 <= s <= shards for s in r["shards"])
        assert all(abs(n - t) <= 3 * mixing.LEAST_BLOCK for (_, t), n in by.items())
    a, b, c = taken.values()
    assert min(sum(a[i] != x[i] for i in a) for x in (b, c)) > len(a) / 20


def test_blocks_are_dealt_by_quota(spark):
    """Each shard's draws are its quota where its own blocks allow that, and all draws together are the seats."""
    sizes = {"a": 10_000, "b": 777, "c": 31, None: 50_000, "d": 0}
    targets = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).withColumn("_key", mixing._key())
    for shards, length in ((16, 10), (5, 3), (16, 1_000), (1, 50)):
        house = sum(sizes.values()) // length
        quotas = mixing.shard_quotas(targets, house, shards)
        want = defaultdict(dict)
        for r in quotas.collect():
            want[r["source"]][r["shard"] - 1] = r["quota"]
        assert sum(sum(q.values()) for q in want.values()) == house
        for r in mixing.block_draws(targets, quotas, length, shards, 3).collect():
            name = None if r["_key"] == "n" else r["_key"][1:]
            n, q = -(-sizes[name] // length), want[name]
            assert r["_blocks"] == n and len(r["_draws"]) == shards
            own = [len(range(k, n, shards)) for k in range(shards)]
            assert all(0 <= d <= o for d, o in zip(r["_draws"], own))
            seats = min(sum(q.values()), 3 * n)
            assert r["_whole"] * n + sum(r["_draws"]) == seats
            for k in range(shards):
                passed = sum(own[(k - p) % shards] for p in range(r["_whole"]))
                if seats == sum(q.values()) and all(0 <= q.get(j, 0) - sum(own[(j - p) % shards] for p in range(r["_whole"])) <= own[j] for j in range(shards)):
                    assert passed + r["_draws"][k] == q.get(k, 0)
