"""The filter before the automaton: it denies no word that is a term, and few words pass that are none."""

import random

from frostline.llm import toxicity


def test_filter_denies_no_term():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcé") for _ in range(n))
    lexicon = {word(n): 1.0 + n for n in (3, 4, 5, 6, 8, 9, 9, 10, 12)} | {word(4) + "*": 2.0, word(5) + "*": 9.0}

    def edited(w):
        k = r.randrange(len(w))
        kind = r.randrange(4)
        return w[:k] + (word(1) + w[k + 1 :] if kind == 0 else w[k + 1 :] if kind == 1 else word(1) + w[k:] if kind == 2 else w[k : k + 2][::-1] + w[k + 2 :])

    terms = [t.rstrip("*") for t in lexicon]
    words = {edited(w) or "a" for w in terms for _ in range(60)} | {edited(edited(w) or "a") for w in terms for _ in range(120)} | {t + word(n) for t in terms for n in range(30)} | {word(n) for n in range(1, 50)} | set(terms) | {"", '"'}
    met, walked = toxicity.FuzzyTrie(lexicon), toxicity.FuzzyTrie(lexicon)
    met.meet([list(words), [], ["a"]])
    assert {w: met.hits.get(w) for w in words} == {w: walked.walk(w) for w in words} and words <= met.known
    assert sum(walked.walk(w) is not None and walked.walk(w)[2] == 2 for w in words) > 50


def test_few_words_pass_and_memory_is_bounded():
    trie = toxicity.FuzzyTrie({"worthless": 4.0, "idiot": 5.0, "zorb*": 2.0}, most_known=10)
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 14))) for _ in range(5000)]
    assert trie.shortened.may_be_terms(words).sum() < 100
    assert trie.shortened.may_be_terms(["idiot", "w0rthles", "zorbing", "x" * 500, "zorb" + "y" * 500]).tolist() == [True, True, True, False, True]
    for text in ("a b c d e f g h", "an idiot spoke", "i j k l m n o p", "idiot"):
        assert len(trie.known) <= 10
        assert toxicity.text_features(text, trie)[2] == ("idiot" in text)
    empty = toxicity.FuzzyTrie({})
    assert empty.find("word") is None and toxicity.text_features("any text", empty) == (0.0, 0.0, 0, 0, 0, 0.0)
