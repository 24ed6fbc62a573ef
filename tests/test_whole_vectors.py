"""Propagation of whole vectors against brute force."""

import os
from collections import defaultdict

import pytest

from frostline import plans
from frostline.plans import base

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_whole_vectors(spark):
    v = {r["vec_id"]: list(r["v"]) for r in base.vectors(spark, SF).collect()}
    edges = [tuple(r) for r in plans.QUERIES["sym_norm"](spark, SF).select("user_id", "item_id", "w").collect()]
    n = len(v)
    at = {("u", u): v.get((u * 7 + 3) % n) for u, _, _ in edges} | {("i", i): v.get(i % n) for _, i, _ in edges}
    want = defaultdict(float)
    for node, x in at.items():
        for k, c in enumerate(x or []):
            want[*node, k + 1] += c / 2
    for u, i, w in edges:
        for to, of in ((("i", i), ("u", u)), (("u", u), ("i", i))):
            for k, c in enumerate(at[of] or []):
                want[*to, k + 1] += w * c / 2
    got = {(r["side"], r["id"], r["pos"]): r["x"] for r in plans.QUERIES["propagate_one_layer"](spark, SF).collect()}
    assert set(got) == set(want) and max(pos for _, _, pos in got) == max(map(len, v.values())) > 8
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)
