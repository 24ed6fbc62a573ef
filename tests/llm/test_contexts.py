"""Factors of contexts, learned from labels and held against counts made one by one."""

import math

import pytest

from frostline.llm import toxicity


def test_factors_are_the_counted_odds(spark):
    said, you, plain, quoted = "she said glorp today", "you are a glorp", "a glorp here", 'the "glorp" here'
    rows = [(said, 1)] * 10 + [(said, 0)] * 90 + [(you, 1)] * 100 + [(plain, 1)] * 60 + [(plain, 0)] * 20 + [("calm text", 0)] * 300 + [(None, 0), ("", 1), (f"{plain} {plain}", 1)]
    lexicon = spark.sparkContext.broadcast({"glorp": 4.0})
    got = toxicity.learn_factors(spark.createDataFrame([*rows, (quoted, 0)], "text string, toxic int"), lexicon)
    toxic, clean = 172, 412
    odds = lambda x, y: math.log((x + 0.5) / (toxic + 1)) - math.log((y + 0.5) / (clean + 1))
    whole = odds(171, 111)
    for context, x, y in ((0, 61, 20), (toxicity.QUOTED, 0, 1), (toxicity.REPORTED, 10, 90), (toxicity.ADDRESSED, 100, 0), (toxicity.QUOTED + toxicity.ADDRESSED, 0, 0)):
        share = min(max(odds(x, y) / whole, 0.0), 1.5)
        assert got[context] == pytest.approx(((x + y) * share + 20 * toxicity.PRIOR_FACTORS[context]) / (x + y + 20)), context
    assert got[toxicity.REPORTED] < got[0] < got[toxicity.ADDRESSED]


def test_factors_without_hits_are_the_priors(spark):
    lexicon = spark.sparkContext.broadcast({})
    for rows in ([], [("calm", 0), (None, 1)]):
        assert toxicity.learn_factors(spark.createDataFrame(rows, "text string, toxic int"), lexicon) == toxicity.PRIOR_FACTORS


def test_contexts():
    words = 'you said the "glorp" is a glorp'.split()
    assert toxicity.contexts(words, [3, 6]) == [7, 6] and toxicity.contexts(words, []) == []


def test_states_made_anew_find_the_same():
    lexicon = {"idiot": 5.0, "worthless": 4.0, "scum": 3.0, "zorb*": 2.0}
    words = [w for k in range(40) for w in (f"idi{k}ot", f"worthl{k}ss", f"w{k}rthlss", f"zorb{k}", f"s{k}um")]
    one, other = toxicity.FuzzyTrie(lexicon, most_states=3), toxicity.FuzzyTrie(lexicon)
    assert [one.find(w) for w in words] == [other.find(w) for w in words] and len(one.sets) < len(other.sets)
