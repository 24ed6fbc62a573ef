"""Toxicity: a lexicon learned from labels, misspellings by Levenshtein automaton, context windows.

Terms (words, and stems that start many words) are mined from the document frequencies of all labelled
training documents.  They form a trie; the automaton of words within a few edits of a term is the trie
walked with edit counts, made deterministic state by state as words need it.  A hit counts for more or
less by its context, whether its window of words quotes it, reports it or addresses someone; by how much
is learned from all labelled documents.
"""

from __future__ import annotations

import gc
import math
import re
import zlib
from dataclasses import replace
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import trees
from frostline.llm.common import by_smallest_hash, fold, kept, materialize, table

#: Marks around words, marks of quotation, words that report speech and that address someone.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„‚‹›¿¡…–—"
QUOTES = '"«»“”„‹›'
QUOTED_WORD = re.compile(f"[{QUOTES}]").search
REPORTING = frozenset("said says say wrote writes quoted quote quotes called calling word words term terms reported sagte schrieb zitat zitiert wort nannte dit écrit cité citation mot appelé dijo escribió cita citó palabra llamó".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dir ihr euch dein deine tu te toi vous votre ton usted ustedes tú vosotros".split())
STEMS = (4, 5, 6)
#: Share of toxic documents that is assumed where labels of one class are missing: nothing is toxic then.
PRIOR = 0.01
#: Bits of a map of terms, and of the part of it that Spark makes at once.
BITS, BUCKET = 2**23, 2**15
#: In place of an awaited letter: the word goes on after a stem.  No letter equals it.
STEM = "stem"

#: Parts of a context, added up to its number.
QUOTED, REPORTED, ADDRESSED = 1, 2, 4
SPEECH = {w: REPORTED * (w in REPORTING) + ADDRESSED * (w in ADDRESS) for w in REPORTING | ADDRESS}
#: Factors of a hit's weight by number of its context, before labels tell more.
PRIOR_FACTORS = (1.0, 0.5, 0.8, 0.25, 1.2, 0.5, 0.96, 0.25)

HIT_SUMS = {"sums": "array<double>", "tops": "array<double>", "exact": "long", "misspelled": "long", "quoted": "long", "words": "long"}
FEATURES = {"abuse": 1, "strongest": 1, "exact": 1, "misspelled": 1, "quoted": 0, "density": 1}
KINDS = ", ".join(f"{f} double" for f in FEATURES)


def bare(word: str) -> str:
    return word.strip(MARKS)


def _terms(words: list[str]) -> set[str]:
    found = set()
    for w in {bare(w) for w in words}:
        if 3 <= len(w) <= 40:
            found.add(w)
            found.update(w[:k] + "*" for k in STEMS if len(w) > k)
    return found


def _count_terms(docs: DataFrame, bits=None) -> DataFrame:
    """Document frequencies of terms; with ``bits``, a broadcast map of marks, of those with a mark (and some others)."""

    def count(batches):
        held: Counter[str] = Counter()
        marks = None if bits is None else np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little")

        def rows():
            terms = [t for t in held if marks is None or marks[zlib.crc32(t.encode()) % BITS]]
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([held[t] for t in terms], pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(_terms((text or "").lower().split()))
            if len(held) > 300_000:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _marks(terms: DataFrame) -> bytes:
    """A map of BITS bits with those of the terms' crc32 set."""
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BITS))
    found = terms.groupBy(F.floor(at / BUCKET).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.pmod(at, F.lit(BUCKET))).alias("b")).collect()
    out = bytearray(BITS // 8)
    for r in found:
        out[r["k"] * BUCKET // 8 : r["k"] * BUCKET // 8 + BUCKET // 8] = bytes(r["b"]).ljust(BUCKET // 8, b"\0")[: BUCKET // 8]
    return bytes(out)


def learn_lexicon(labelled: DataFrame, least: int = 3, evidence: float = 18.0) -> dict[str, float]:
    """Terms and their log odds, from all labelled rows (text, toxic) given.

    A term stays if it is in at least ``least`` toxic documents, its log odds are 2.5 at least and its
    likelihood ratio against no difference reaches ``evidence``; a stem, if besides many words share it.
    Both frequencies are joined and judged in Spark, and only terms that stay are collected.  A term in x
    toxic documents has a ratio of 2 x log(documents / toxic documents) at most, so that those below are
    left out before clean documents are counted; of these, terms without a mark in a map of the rest.
    """
    spark = labelled.sparkSession
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    share = toxic / (toxic + clean)
    counted = materialize(_count_terms(labelled.where("toxic = 1")).where(F.col("n") >= least), "terms")
    often = counted.where(-2 * math.log(share) * F.col("n") >= evidence - 1e-6)
    bits = spark.sparkContext.broadcast(_marks(often))
    rare = _count_terms(labelled.where("toxic = 0"), bits).withColumnRenamed("n", "y")
    x, y = F.col("n"), F.coalesce("y", F.lit(0))
    log_odds = F.log((x + 0.5) / (toxic + 1)) - F.log((y + 0.5) / (clean + 1))
    ratio = 2 * (x * F.log(x / ((x + y) * share)) + F.when(y > 0, y * F.log(y / ((x + y) * (1 - share)))).otherwise(0.0))
    judged = often.join(rare, "term", "left").withColumn("o", log_odds).where((F.col("o") >= 2.5) & (ratio >= evidence))
    # A stem's commonest single word, among all counted.
    starts = F.explode(F.array(*[F.concat(F.substring("term", 1, k), F.lit("*")) for k in STEMS])).alias("term")
    tops = counted.where(~F.col("term").endswith("*")).select(F.col("n").alias("top"), F.length("term").alias("_len"), starts).where("_len >= length(term)").groupBy("term").agg(F.max("top").alias("top"))
    kept = judged.join(tops, "term", "left").select("term", "n", "o", "top").collect()
    a, odds = {r["term"]: r["n"] for r in kept}, {r["term"]: r["o"] for r in kept}
    top = {r["term"][:-1]: r["top"] for r in kept if r["top"] is not None}
    stems: list[str] = []
    for t in sorted((t for t in odds if t.endswith("*")), key=lambda t: (-len(t), t)):
        stem = t[:-1]
        longer = max((a[s] for s in stems if s.startswith(stem)), default=0)
        if a[t] >= 1.3 * top.get(stem, 0) and a[t] > 1.02 * longer:
            stems.append(stem + "*")
    words = [t for t in odds if not t.endswith("*")]  # also those of a stem: a stem has no edits, they have
    return {t: odds[t] for t in (*stems, *words)}


#: Base and multiplier of hashes of words, modulo 2**64.
BASE, SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: What left-out letters a term's hashes are kept for: those of terms without edits, with one, with two; and of stems.
BY_EDITS, STEMS_BIT = (1, 2, 4), 8


class Shortened:
    """Tells, many words at once, which may be a term: those that agree with one once letters are left out of both.

    A word within e edits of a term agrees with it after at most e letters are left out of either (a swap
    leaves one out of both), so no word that is a term is denied; what passes goes to the automaton.
    Shortened words are compared by hashes, sums of letters times powers of BASE, in numpy.
    """

    def __init__(self, lexicon: dict[str, float]):
        words = [t for t in lexicon if not t.endswith("*")]
        self.stem_lengths = sorted({len(t) - 1 for t in lexicon if t.endswith("*")})
        #: Words that are longer can only be words of a stem.
        self.most = max((len(w) + 2 for w in words), default=0)
        self.cut = max([self.most + 1, *self.stem_lengths])
        self.up = np.array([pow(BASE, k, 2**64) for k in range(self.cut + 3)], np.uint64)
        found = [(np.zeros(0, np.uint64), 0)]
        for edits, bit in enumerate(BY_EDITS):
            for _, rows in self._by_length([w for w in words if edits_of(w) == edits]):
                found += [(h.ravel(), bit) for h in self._hashes(rows, edits)]
        for _, rows in self._by_length([t[:-1] for t in lexicon if t.endswith("*")]):
            found.append((self._hashes(rows, 0)[0].ravel(), STEMS_BIT))
        hashes = np.concatenate([h for h, _ in found])
        self.hashes, at = np.unique(hashes, return_inverse=True)
        self.bits = np.zeros(len(self.hashes), np.uint8)
        np.bitwise_or.at(self.bits, at, np.concatenate([np.full(len(h), bit, np.uint8) for h, bit in found]))
        size = min(max(16, len(self.hashes).bit_length() + 5), 24)
        self.shift, self.table = np.uint64(64 - size), np.zeros(2**size, np.uint8)
        np.bitwise_or.at(self.table, self.hashes >> self.shift, self.bits)

    def _by_length(self, words: list[str]):
        """(places, letters of these words in rows) for each length."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, places in by.items():
            letters = "".join([words[k] for k in places]).encode("utf-32-le", "surrogatepass")
            yield places, np.frombuffer(letters, np.uint32).reshape(len(places), n).astype(np.uint64)

    def _hashes(self, rows: np.ndarray, edits: int):
        """Hashes of the rows' words without up to ``edits`` letters: an array each for 0, 1, 2 letters left out."""
        m, n = rows.shape
        zero = np.zeros((m, 1), np.uint64)
        # Sums of the letters before each place, at their own powers and at those one and two below.
        own = np.concatenate([zero, np.cumsum(rows * self.up[2 : n + 2], axis=1)], axis=1)
        one = np.concatenate([zero, np.cumsum(rows * self.up[1 : n + 1], axis=1)], axis=1)
        out = [own[:, -1:] * SPREAD]
        if edits > 0 and n > 0:
            out.append((own[:, :-1] + (one[:, -1:] - one[:, 1:])) * SPREAD)
        if edits > 1 and n > 1:
            two = np.concatenate([zero, np.cumsum(rows * self.up[:n], axis=1)], axis=1)
            later = one[:, :-1] + (two[:, -1:] - two[:, 1:])
            out.append(np.concatenate([own[:, i : i + 1] - one[:, i + 1 : i + 2] + later[:, i + 1 :] for i in range(n - 1)], axis=1) * SPREAD)
        return out

    def _has(self, hashes: np.ndarray, mask: int) -> np.ndarray:
        """Rows of which some hash is one of the terms' with a bit of ``mask``."""
        out = np.zeros(len(hashes), bool)
        row, col = np.nonzero(self.table[hashes >> self.shift] & np.uint8(mask))
        if len(row):
            h = hashes[row, col]
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out[row[(self.hashes[k] == h) & (self.bits[k] & mask > 0)]] = True
        return out

    def may_be_terms(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), bool)
        for places, rows in self._by_length([w[: self.cut] for w in words]):
            found = np.zeros(len(rows), bool)
            for k in self.stem_lengths:
                if k <= rows.shape[1]:
                    found |= self._has(self._hashes(rows[:, :k], 0)[0], STEMS_BIT)
            if rows.shape[1] <= self.most:
                for h, mask in zip(self._hashes(rows, 2), (7, 6, 4)):
                    found |= self._has(h, mask)
            out[places] = found
        return out


def edits_of(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class FuzzyTrie:
    """Finds the term that a word is, within edits: insertions, deletions, changes and swaps.

    Words of 5 letters or more may have one edit, of 9 or more two; stems have none, and win over words.
    States of the automaton are sets of (node, edits, letter awaited after a swap, or STEM past a stem's
    end), made as words lead there; beyond ``most_states`` they are made anew, so memory is bounded.
    """

    def __init__(self, lexicon: dict[str, float], most_known: int = 400_000, most_states: int = 100_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[str, float, int] | None] = [None]
        self.stem: list[tuple[str, float, int] | None] = [None]
        self.reach = [0]
        for t, weight in sorted(lexicon.items()):
            stem = t.endswith("*")
            word = t.rstrip("*")
            edits = 0 if stem else edits_of(word)
            node = 0
            self.reach[0] = max(self.reach[0], edits)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.term.append(None), self.stem.append(None), self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            (self.stem if stem else self.term)[node] = (t, weight, edits)
        self.shortened = Shortened(lexicon)
        #: Words met, what those are that are terms, and which report speech or address someone.
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, float, int]] = {}
        self.speech: dict[str, int] = {}
        self.most_known, self.most_states = most_known, most_states
        self._restart()

    def _restart(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        reach, seen = self.reach, set(items)
        todo = [x for x in items if not x[2] and x[1] < reach[x[0]]]
        while todo:  # letters left out of the word
            node, e, _ = todo.pop()
            for child in self.children[node].values():
                if e < reach[child] and (child, e + 1, "") not in seen:
                    seen.add((child, e + 1, ""))
                    if e + 1 < reach[child]:
                        todo.append((child, e + 1, ""))
        best = {}
        for node, e, wait in seen:
            best[node, wait] = min(e, best.get((node, wait), 9))
        key = frozenset((node, e, wait) for (node, wait), e in best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out, children, reach, stem = set(), self.children, self.reach, self.stem
        add = out.add
        for node, e, wait in self.sets[state]:
            if wait:
                if wait == STEM:
                    add((node, e, STEM))
                elif c == wait:
                    add((node, e, ""))
                continue
            if e == 0 and stem[node]:
                add((node, 0, STEM))  # a stem takes any ending
            below = children[node]
            if c in below:
                add((below[c], e, ""))
            if e < reach[node]:
                add((node, e + 1, ""))
                for x, child in below.items():
                    if x != c and e < reach[child]:
                        add((child, e + 1, ""))
                        after = children[child].get(c)
                        if after is not None and e < reach[after]:
                            add((after, e + 1, x))
        return self._state(out) if out else -1

    def meet(self, texts: list[list[str]]) -> None:
        """Has all words of the texts in ``known``; the automaton is spared those that can be no term."""
        words = set().union(*texts)
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > self.most_known:
            self.known.clear(), self.hits.clear(), self.speech.clear()
            new = list(words)
        for a in range(0, len(new), 4096):
            part = [(raw, bare(raw)) for raw in new[a : a + 4096]]
            self.speech.update((raw, SPEECH[w]) for raw, w in part if w in SPEECH)
            for k in np.flatnonzero(self.shortened.may_be_terms([w for _, w in part])):
                if hit := self.walk(part[k][0]):
                    self.hits[part[k][0]] = hit
        self.known.update(new)

    def find(self, raw: str) -> tuple[str, float, int] | None:
        """(term, log odds, edits) of the nearest term, or None."""
        if raw not in self.known:
            self.meet([[raw]])
        return self.hits.get(raw)

    def walk(self, raw: str) -> tuple[str, float, int] | None:
        """What ``find`` gives, by the automaton."""
        if len(self.sets) > self.most_states:
            self._restart()
        state = self.start
        for c in bare(raw):
            step = self.next[state]
            if c not in step:
                step[c] = self._step(state, c)
            state = step[c]
            if state < 0:
                break
        hit = None
        if state >= 0:
            ends = [(e, 1, -self.term[n][1], self.term[n][0]) for n, e, wait in self.sets[state] if not wait and self.term[n] and e <= self.term[n][2]]
            stems = [(0, 0, -self.stem[n][1], self.stem[n][0]) for n, e, wait in self.sets[state] if wait in ("", STEM) and self.stem[n] and e == 0]
            if ends or stems:
                e, _, w, t = min(ends + stems)
                hit = (t, -w, e)
        return hit


def contexts(words: list[str], hits: list[int], speech: dict[str, int] | None = None, window: int = 6) -> list[int]:
    """For each hit the number of its context: QUOTED, REPORTED and ADDRESSED, added up.

    ``speech`` has the words of SPEECH as they stand in the text, where that is known.
    """
    if not hits:
        return []
    marks, inside, last = [], False, 0
    for i, w in enumerate(words if QUOTED_WORD(" ".join(words)) else ()):  # a word opens or closes a quotation by the quotation marks on it
        if QUOTED_WORD(w):
            marks += [inside] * (i - last) + [True]
            inside ^= sum(c in QUOTES for c in w) % 2 == 1
            last = i + 1
    marks += [inside] * (len(words) - last)
    if speech is None:
        speech = {w: SPEECH[bare(w)] for w in set(words) if bare(w) in SPEECH}
    said = [(i, speech[w]) for i, w in enumerate(words) if w in speech]
    out, first = [], 0
    for i in hits:
        while first < len(said) and said[first][0] < i - window:
            first += 1
        near = 0
        for j, kind in said[first : first + 2 * window + 1]:
            near |= kind if j <= i + window else 0
        quoted = marks[i] and (any(marks[i + 1 : i + window + 1]) or bool(QUOTED_WORD(words[i])))
        out.append(QUOTED * quoted + near)
    return out


def words_met(texts: list[str | None], trie: FuzzyTrie, most: int = 100_000):
    """The words of each text, known to the trie, which meets texts of about ``most`` words together."""
    held, n = [], 0
    for text in texts:
        held.append((text or "").lower().split())
        n += len(held[-1])
        if n >= most:
            trie.meet(held)
            yield from held
            held, n = [], 0
    trie.meet(held)
    yield from held


def hit_sums(words: list[str], trie: FuzzyTrie) -> tuple:
    """HIT_SUMS of words that the trie has met: for each context the sum and the greatest of its hits' weights,
    before factors, then numbers of hits and of words."""
    found = trie.hits
    hits = [i for i, w in enumerate(words) if w in found]
    sums, tops = [0.0] * len(PRIOR_FACTORS), [0.0] * len(PRIOR_FACTORS)
    exact = misspelled = quoted = 0
    for i, context in zip(hits, contexts(words, hits, trie.speech)):
        _, weight, edits = found[words[i]]
        s = weight * 0.8**edits
        sums[context], tops[context] = sums[context] + s, max(tops[context], s)
        inside = bool(context & QUOTED)
        exact, misspelled, quoted = exact + (edits == 0 and not inside), misspelled + (edits > 0 and not inside), quoted + inside
    return sums, tops, exact, misspelled, quoted, len(words)


def weighed(sums: list, tops: list, exact: int, misspelled: int, quoted: int, words: int, factors: tuple[float, ...]) -> tuple[float, ...]:
    """FEATURES from HIT_SUMS and the factors of contexts."""
    abuse = sum(f * s for f, s in zip(factors, sums))
    strongest = max(f * s for f, s in zip(factors, tops))
    return (min(abuse, 100.0), strongest, min(exact, 20), min(misspelled, 20), min(quoted, 20), min(20.0, abuse / max(words, 1) * 100))


def text_features(text: str | None, trie: FuzzyTrie, factors: tuple[float, ...] = PRIOR_FACTORS) -> tuple[float, ...]:
    """FEATURES of a text; null and empty texts have zeros.  ``factors``: of a hit's weight, by context."""
    return weighed(*hit_sums(next(words_met([text], trie)), trie), factors)


@contextmanager
def _uncollected():
    """States hold no references to one another, so the search for cycles among them is put off."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _trie(terms: tuple[tuple[str, float], ...]) -> FuzzyTrie:
    """The trie of a lexicon, kept with the states it has made from task to task of a Python process."""
    return kept("toxicity", tuple(terms), lambda: FuzzyTrie(dict(terms)))


def _with_sums(labelled: DataFrame, lexicon) -> DataFrame:
    """HIT_SUMS of labelled texts beside doc_id and toxic."""
    kinds = ", ".join(f"{c} {t}" for c, t in HIT_SUMS.items())

    def summed(batches):
        trie = _trie(lexicon.value)
        for batch in batches:
            with _uncollected():
                cols = list(zip(*(hit_sums(w, trie) for w in words_met(batch.column("text").to_pylist(), trie)))) or [()] * len(HIT_SUMS)
            types = [pa.list_(pa.float64())] * 2 + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "toxic", *HIT_SUMS])

    return labelled.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(summed, f"doc_id long, toxic int, {kinds}")


def factors_of(summed: DataFrame, shrink: float = 20.0) -> tuple[float, ...]:
    """Factors by context, from the HIT_SUMS of all labelled texts.

    A context's log odds are those of a document having a hit in it, toxic against clean; its factor is
    their share of the log odds of a hit in any context, from 0 to 1.5.  It is averaged with the context's
    prior factor, which counts as much as ``shrink`` documents do.
    """
    within = [F.count(F.when(F.col("tops")[c] > 0, 1)).alias(f"in{c}") for c in range(len(PRIOR_FACTORS))]
    anywhere = F.count(F.when(F.array_max("tops") > 0, 1)).alias("anywhere")
    n = {r["toxic"]: r for r in summed.groupBy("toxic").agg(*within, anywhere, F.count("*").alias("all")).collect()}
    if 0 not in n or 1 not in n:
        return PRIOR_FACTORS

    def log_odds(column: str) -> float:
        return math.log((n[1][column] + 0.5) / (n[1]["all"] + 1)) - math.log((n[0][column] + 0.5) / (n[0]["all"] + 1))

    whole = log_odds("anywhere") if n[0]["anywhere"] + n[1]["anywhere"] else 0.0
    if whole <= 0:
        return PRIOR_FACTORS
    out = []
    for c, prior in enumerate(PRIOR_FACTORS):
        seen = n[0][f"in{c}"] + n[1][f"in{c}"]
        out.append((seen * min(max(log_odds(f"in{c}") / whole, 0.0), 1.5) + shrink * prior) / (seen + shrink))
    return tuple(out)


def learn_factors(labelled: DataFrame, lexicon) -> tuple[float, ...]:
    """``factors_of`` the labelled rows (text, toxic) given, with a broadcast lexicon."""
    terms = labelled.sparkSession.sparkContext.broadcast(tuple(sorted(lexicon.value.items())))
    return factors_of(_with_sums(labelled.withColumn("doc_id", F.lit(0).cast("long")), terms))


def _features(batch: pa.RecordBatch, trie: FuzzyTrie, factors: tuple[float, ...]) -> np.ndarray:
    with _uncollected():
        return np.array([weighed(*hit_sums(w, trie), factors) for w in words_met(batch.column("text").to_pylist(), trie)], float).reshape(-1, len(FEATURES))


def _sampled(summed: DataFrame, factors: tuple[float, ...]) -> DataFrame:
    """FEATURES of labelled texts from their HIT_SUMS."""

    def weigh(batches):
        for batch in batches:
            x = np.array([weighed(*r, factors) for r in zip(*(batch.column(c).to_pylist() for c in HIT_SUMS))], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["doc_id", *FEATURES])

    return summed.mapInArrow(weigh, f"doc_id long, {KINDS}")


def toxicity_model(docs: DataFrame, labels: DataFrame, most_rows: int = 40_000):
    """The lexicon, the contexts' factors and the trees over FEATURES, learned from labelled rows that aren't held out.

    The lexicon's and the contexts' frequencies cover all of them; the trees are fitted to at most ``most_rows``, one row an
    id and those with the smallest hashes of their ids.  Where they lack labels of either class, there are
    no terms and every score is PRIOR.
    """
    spark = docs.sparkSession
    marked = labels.where("toxic in (0, 1)").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Merged at every size: labels grow with the documents, so they are never broadcast.
    labelled = materialize(docs.select("doc_id", "text").join(marked.hint("merge"), "doc_id"), "labelled")
    lexicon = spark.sparkContext.broadcast(tuple(sorted(learn_lexicon(labelled).items())))
    summed = materialize(_with_sums(labelled, lexicon), "hits")
    factors = factors_of(summed)
    sample = _sampled(by_smallest_hash(summed, summed.count(), most_rows), factors)
    once = sample.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x")).select("doc_id", "x.*")
    rows = once.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).toPandas()
    x, y = rows[list(FEATURES)].to_numpy(float), rows["toxic"].to_numpy(float)
    model = trees.fit(x, y, np.array(list(FEATURES.values())), trees=40, depth=3)
    if not 0 < y.sum() < len(y):
        model = replace(model, start=math.log(PRIOR / (1 - PRIOR)))
    return lexicon, factors, spark.sparkContext.broadcast(model)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and FEATURES of every document.

    Null and empty texts score as texts without hits.  Repeated rows are each scored.  Labels of unknown
    documents and null labels play no part; without labels of both classes every score is PRIOR.
    """
    lexicon, factors, model = toxicity_model(docs, labels)

    def judge(batches):
        trie = _trie(lexicon.value)
        for batch in batches:
            x = _features(batch, trie, factors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[:, k]) for k in range(x.shape[1])), pa.array(model.value.score(x))], ["doc_id", *FEATURES, "score"])

    scored = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id long, {KINDS}, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *FEATURES)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts aren't predicted to be toxic; in one pass.

    Without labels of both classes all rows stay.
    """
    lexicon, factors, model = toxicity_model(docs, labels)

    def keep(batches):
        trie = _trie(lexicon.value)
        for batch in batches:
            x = _features(batch, trie, factors)
            yield batch.filter(pa.array(model.value.score(x) < 0.5, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
