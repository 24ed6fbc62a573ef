"""Surrogates of long values: no counting up to a root, no overflow, one-to-one in pieces."""

import random
import signal
import string

import pytest

from frostline.llm import surrogates

KEY = b"k"


@pytest.fixture
def seconds():
    """Ends a call that would take for ever."""

    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, 30)
    yield
    signal.setitimer(signal.ITIMER_REAL, 0)
    signal.signal(signal.SIGALRM, before)


def test_long_values_take_no_time(seconds):
    rng = random.Random(3)
    made = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    for n in (20, 24, 36, 40, 64, 65, 200, 400, 6_000):
        for kind, value in (("email", made(n, string.ascii_lowercase) + "@mail5.example.com"), ("secret", made(n, string.ascii_letters + string.digits)), ("secret", made(n, "0123456789abcdef"))):
            new = surrogates.surrogate(kind, value, KEY)
            assert len(new) == len(value) and new != value
            # Characters agree by chance only, in the first half and in the second.
            for part in (slice(0, n // 2), slice(n // 2, n)):
                assert sum(a == b for a, b in zip(value[part], new[part])) < 0.2 * n // 2 + 6
            if kind == "secret":
                assert [(c.isdigit(), c.isupper()) for c in new] == [(c.isdigit(), c.isupper()) for c in value] or set(value) <= set("0123456789abcdef")


def test_a_text_of_long_addresses_is_replaced(spark, seconds):
    texts = [(k, f"write to {chr(97 + k) * 24}@mail5.example.com, token={'aZ9' * 900}{k}") for k in range(4)]
    got = surrogates.with_surrogates(spark.createDataFrame(texts, "doc_id long, text string"), KEY).collect()
    assert len({e["surrogate"] for r in got for e in r["entities"]}) == 8
    assert all(len(r["text"]) == len(t) for r, (_, t) in zip(sorted(got), texts))


def test_pieces_are_one_to_one(monkeypatch):
    monkeypatch.setattr(surrogates, "PIECE", 1)
    new = {f"{x:03d}": surrogates._formatted(f"{x:03d}", KEY, "t") for x in range(1_000)}
    assert sorted(new.values()) == sorted(new)
    # The first character hangs on the last one.
    assert sum(new[f"{x:02d}0"][0] != new[f"{x:02d}1"][0] for x in range(100)) > 60


def test_the_stage_ends_on_long_values(spark, seconds, tmp_path):
    """The pipeline's stage, with repeated rows and a value of 5,000 letters; n_chars is that of the new text."""
    import corpus_pipeline

    texts = [(k % 3, f"key {'ab' * 12}@mail5.example.com and api_key: {'xY3' * (1_700 if k == 4 else 14)}") for k in range(5)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.pii_stage(spark, docs, str(tmp_path)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) and "abab" not in r.text and "xY3xY3" not in r.text for r in got)
