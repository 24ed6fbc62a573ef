"""Queries that read and group the pairs once."""

from frostline.plans import QUERIES, base


def test_policy_grid_builds_the_pairs_once_and_no_users_vectors(spark, monkeypatch):
    calls, made = [], base.interactions
    monkeypatch.setattr(base, "interactions", lambda *a: calls.append("pairs") or made(*a))
    monkeypatch.setattr(base, "user_vectors", lambda *a: calls.append("users"))
    QUERIES["policy_grid"](spark, "/root/testdata/sf0.001")
    assert calls == ["pairs"]
