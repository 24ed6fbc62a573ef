"""The lexicon and its trie: inflected families, rare terms."""

from frostline.llm import toxicity


def family(spark, clean=300):
    bad = ["idiot"] * 60 + ["idiots"] * 30 + ["idiotic"] * 30
    rows = [(f"you are word{k} {t} here", 1) for k, t in enumerate(bad)] + [(f"a calm text of day{k}", 0) for k in range(clean)]
    return spark.createDataFrame(rows, "text string, toxic int")


def test_misspelled_members_of_a_stem(spark):
    lexicon = toxicity.learn_lexicon(family(spark))
    assert "idiot" in lexicon and any(t.endswith("*") for t in lexicon)
    trie = toxicity.FuzzyTrie(lexicon)
    for w in ("1diot", "idoit", "iddiot"):
        hit = trie.find(w)
        assert hit and hit[2] == 1 and hit[0].startswith("idiot"), w
    assert trie.find("idiotxyz")[0].endswith("*") and trie.find("idiotxyz")[2] == 0 and trie.find("calm") is None


def test_stems_and_words_in_one_trie():
    trie = toxicity.FuzzyTrie({"idio*": 3.0, "idiots": 9.0, "f*ckers": 4.0})
    assert trie.find("idiotqs")[0] == "idio*" and trie.find("idiots") == ("idio*", 3.0, 0)
    assert trie.find("idots") == ("idiots", 9.0, 1) and trie.find("fc*kers") == ("f*ckers", 4.0, 1)


def test_rare_terms_are_learned(spark):
    """Some in fewer than 0.5 % of the toxic documents, judged by their odds and ratio as counted one by one."""
    rows = [("common glorp" + (" rareabuse" if k % 400 == 0 else "") + (" shared" if k % 2 else ""), 1) for k in range(2000)]
    rows += [(f"plain text{k % 50}" + (" shared" if k % 2 else "") + (" glorp" if k % 900 == 0 else ""), 0) for k in range(4000)]
    got = toxicity.learn_lexicon(spark.createDataFrame([*rows, *rows[:5]], "text string, toxic int"))
    assert "glorp" in got and "common" in got and "rareabuse" not in got and "shared" not in got  # 5 of 2,000 lack the evidence at such a share
    wide = [(f"filler{k}" + (" rareabuse" if k % 250 == 0 else ""), 1) for k in range(2000)] + [("plain text", 0)] * 60000
    got = toxicity.learn_lexicon(spark.createDataFrame(wide, "text string, toxic int"))
    assert set(got) == {t for t in got if "rareabuse".startswith(t.rstrip("*")) or "filler".startswith(t.rstrip("*"))} and "rareabuse" in got
