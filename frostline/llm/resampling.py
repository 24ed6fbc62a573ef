"""Importance resampling towards a target distribution, by hashed n-grams found in suffix arrays of word ids.

A block of whole texts is numbered word by word; its suffixes are sorted by their first words, so that all
occurrences of an n-gram stand together as a run of the longest-common-prefix array.  A run's n-gram is
hashed once and the bucket id is scattered back to the run's occurrences.  Buckets of the whole corpus and
of the target texts are counted that way, their log ratio is a bucket's gain, and a document's weight is
the floored mean of its features' gains.  Gumbel noise from a hash of the id draws without replacement.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm.common import table
from frostline.llm.encoding import slices
from frostline.operators.ids import numbered

#: Words are runs of ASCII letters (A-Z lowered), digits and all that lies beyond ASCII.
_BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _BREAKS, bytes(range(97, 123)) + b" " * len(_BREAKS))


def plain_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a whole text; a null text has none."""
    return text.encode().translate(_PLAIN).split() if text else []


class WordSuffixes:
    """The suffix array of a block of documents over word ids, sorted as deep as ``depth`` words.

    ``ids`` are the block's words one document after another; ``left`` says how many words a position has
    to its document's end, so that no n-gram leaves its document.
    """

    def __init__(self, texts: list[list[bytes]], depth: int):
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(self.sizes.sum()))
        self.words = list(number)
        ends = np.cumsum(self.sizes)
        self.left = np.repeat(ends, self.sizes) - np.arange(len(self.ids))
        rank, known = self.ids, 1
        while known < depth:  # prefix doubling: ranks by twice as many words; 0 is a document's end
            behind = np.zeros(len(rank), np.int64)
            inside = np.flatnonzero(self.left > known)
            behind[inside] = rank[inside + known] + 1
            rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)[1]
            known *= 2
        self.order = np.argsort(rank, kind="stable")
        # Longest common prefixes with the suffix before, in words, as far as depth.
        self.common = np.zeros(len(rank), np.int64)
        if len(rank):
            a, b = self.order[:-1], self.order[1:]
            same = np.ones(len(a), bool)
            for k in range(depth):
                both = same & (self.left[a] > k) & (self.left[b] > k)
                at = np.flatnonzero(both)
                same = np.zeros(len(a), bool)
                same[at] = self.ids[a[at] + k] == self.ids[b[at] + k]
                self.common[1:] += same

    def buckets(self, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where an n-gram starts and the buckets of these n-grams, each run hashed once."""
        whole = self.left[self.order] >= n
        at, head = self.order[whole], (self.common < n)[whole]
        words, crc = self.words, zlib.crc32
        if n == 1:
            hashes = [crc(words[i]) % buckets for i in self.ids[at[head]].tolist()]
        else:
            grams = self.ids[at[head][:, None] + np.arange(n)].tolist()
            hashes = [crc(b" ".join([words[i] for i in g])) % buckets for g in grams]
        return at, np.array(hashes, np.int64)[np.cumsum(head) - 1] if len(at) else np.zeros(0, np.int64)


def bucket_counts(docs: DataFrame, n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, features) over all texts: how many n-grams of 1 to n words, repeats counted, fall to a bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)  # a task sends one row a bucket at most
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                block = WordSuffixes(list(map(plain_words, texts[a:b])), n)
                for k in range(1, n + 1):
                    total += np.bincount(block.buckets(k, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "features"])

    return docs.select("text").mapInArrow(count, "bucket long, features long").groupBy("bucket").agg(F.sum("features").alias("features"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """A bucket's gain, floor(1000 * ln of its smoothed share in the target over that in the documents).

    What reaches the driver is one row a bucket of each table, bounded by ``buckets``.
    """
    counts = [dict(map(tuple, bucket_counts(t, n, buckets).collect())) for t in (docs, target)]
    s_all, t_all = (float(sum(c.values()) + buckets) for c in counts)
    s, t = counts
    gain = lambda b: math.floor(1000 * math.log((t.get(b, 0) + 1.0) * s_all / ((s.get(b, 0) + 1.0) * t_all)))
    return np.array([gain(b) for b in range(buckets)], np.int64)


def importance_weights(docs: DataFrame, gains: np.ndarray, n: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row; ``gains`` has one value a bucket."""
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def score(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words, features, sums = (np.zeros(len(texts), np.int64) for _ in range(3))
            for a, b in slices(texts):
                block = WordSuffixes(list(map(plain_words, texts[a:b])), n)
                words[a:b] = block.sizes
                gained = np.zeros(len(block.ids) + 1, np.int64)
                for k in range(1, n + 1):
                    at, bucket = block.buckets(k, len(gains))
                    gained[at] += gains[bucket]  # a position starts one n-gram of each length
                    features[a:b] += np.maximum(block.sizes - (k - 1), 0)
                upto = np.concatenate([[0], np.cumsum(gained)])
                ends = np.cumsum(block.sizes)
                sums[a:b] = upto[ends] - upto[ends - block.sizes]
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(score, schema)


def importance_sample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; the drawn ones have a rank.

    ``docs`` has doc_id and text, ``target`` text; other columns of either are ignored, whatever their
    names.  Drawn are ``percent`` of a hundred of the documents with ``least_words``, rounded down, those of
    highest score, ties to the smaller doc_id; rank counts them from 1.  Null and empty texts have no
    features and weight 0 and aren't drawn; a null doc_id counts as an empty text in the hash and comes
    first among ties.  Repeated rows are all kept and drawn one by one; rows that tie in score and doc_id
    share an order that is free but fixed in a result.  Very long texts are read whole.  An empty table
    gives an empty result; an empty target leaves all gains to the documents' own counts.
    """
    gains = bucket_gains(docs, target, n, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = importance_weights(docs, gains, n).withColumn("score", (F.col("weight") + noise).cast("long"))
    able = (F.col("n_words") >= least_words).alias("_able")
    placed = numbered(scored.withColumn("_able", able), F.col("_able").desc(), F.col("score").desc(), F.col("doc_id").asc(), name="_rank")
    drawn = placed.agg(F.count_if("_able")).first()[0] * percent // 100
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_able") & (F.col("_rank") <= drawn), F.col("_rank")).cast("long").alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
