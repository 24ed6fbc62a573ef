"""Near-duplicate documents: MinHash with banding, signatures, confirmed links, components.

1. A document's set of word shingles is hashed to 64 bits; equal sets form a class, kept by its least
   doc_id and confirmed text by text, and only classes go on.
2. ``bands * rows`` universal hash minima a class; each band's minima are a bucket's key.
3. In a bucket every class is paired with the least class, not with every other.  Pairs are confirmed on
   the full sets and components are built.
4. Buckets whose classes still lie in several components are compared by signature in blocks.  Pairs of
   different components whose signatures may belong to linked sets make families, as a spanning forest;
   a family's members are held against each other on the full sets, in blocks, and what is linked joins.
   So no pair that shares a bucket goes unchecked unless its ends are already together, and no step makes
   more rows than its members.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.common import discard, kept, lower_words, materialize, table
from frostline.llm.components import connected_components

#: Bits of a seed sequence; multipliers are derived from it, not listed.
_MIX = np.random.default_rng(20_011)
_PLACES = _MIX.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (multiplications by odd numbers and shifts)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _PLACES[62]
        h = (h ^ (h >> np.uint64(29))) * _PLACES[63]
    return h ^ (h >> np.uint64(32))


class WordHashes:
    """64-bit hashes of words; those lately met are kept, up to a bound."""

    def __init__(self, most: int = 150_000):
        self.most, self.known = most, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        digest = xxhash.xxh3_64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, from its words' hashes; fewer words make one shingle."""
    if not len(words):
        return words
    w = min(width, len(words))
    n = len(words) - w + 1
    with np.errstate(over="ignore"):
        h = np.full(n, w, np.uint64) * _PLACES[61]
        for k in range(w):
            h += words[k : n + k] * _PLACES[k]
    return np.unique(_finish(h))


def shingle_set(text: str | None, width: int = 5) -> set[tuple[bytes, ...]]:
    """The full set of a text's shingles, words and all."""
    words = lower_words(text)
    if not words:
        return set()
    w = min(width, len(words))
    return set(zip(*(words[k:] for k in range(w))))


def hash_family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of n universal hash functions x -> (a x + b) mod 2**64 >> 32."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash minima of sets that aren't empty: one row a set, one column a hash function."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(a), len(sets)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(len(a)):
            out[k] = np.minimum.reduceat(x * a[k] + b[k], starts) >> np.uint64(32)
    return out.T


def signatures(docs: DataFrame, width: int, n_hashes: int) -> DataFrame:
    """doc_id, n_shingles, fp1 and fp2 (of the whole set), text_key (128 bits of the text) and sig (minima, 32 bits each) of documents."""

    def sign(batches):
        kept("near_dedup")
        a, b = hash_family(n_hashes)
        known = WordHashes()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            sets = [shingle_hashes(known.of(lower_words(t)), width) for t in texts]
            sizes = np.array([len(s) for s in sets])
            with np.errstate(over="ignore"):
                fps = np.array([(int(s.sum()), int(np.bitwise_xor.reduce(_finish(s + _PLACES[60])))) if len(s) else (0, 0) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            sigs: list[bytes | None] = [None] * len(sets)
            part, held = [], 0
            for i in range(len(sets) + 1):
                if part and (i == len(sets) or held + len(sets[i]) > 120_000):
                    for k, row in zip(part, minima([sets[k] for k in part], a, b)):
                        sigs[k] = row.tobytes()
                    part, held = [], 0
                if i < len(sets) and sizes[i]:
                    part.append(i)
                    held += sizes[i]
            keys = pa.array([hashlib.blake2b(t.encode(), digest_size=16).digest() if t else None for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(fps[:, 0]), pa.array(fps[:, 1]), keys, pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "fp1", "fp2", "text_key", "sig"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, fp1 long, fp2 long, text_key binary, sig binary")


def band_rows(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node, n) for every band of every class: the bucket is a hash of the band's minima."""

    def spread(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, -1).astype(np.uint64)
            with np.errstate(over="ignore"):
                for band in range(bands):
                    h = np.full(n, band, np.uint64) * _PLACES[61]
                    for k in range(rows):
                        h += sig[:, band * rows + k] * _PLACES[k]
                    yield pa.RecordBatch.from_arrays([pa.array(_finish(h).view(np.int64)), batch.column("node"), batch.column("n_shingles")], ["bucket", "node", "n"])

    return classes.select("node", "n_shingles", "sig").mapInArrow(spread, "bucket long, node long, n long")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough: 100 * common >= percent * union."""
    texts = docs.select(F.col("doc_id"), "text")
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def check(batches):
        last, of = None, set()
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if ta != last:
                    last, of = ta, shingle_set(ta, width)
                other = shingle_set(tb, width)
                common = len(of & other)
                keep.append(bool(common) and 100 * common >= percent * (len(of) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def _close(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of equal minima of each row of one with each of the other."""
    out = np.empty((len(left), len(right)), np.float32)
    for i in range(0, len(left), 32):
        out[i : i + 32] = (left[i : i + 32, None, :] == right[None, :, :]).mean(axis=2, dtype=np.float32)
    return out


class Sets:
    """Disjoint sets of numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Rows of each group dealt to blocks of about ``block``, and repeated for every pair (lo, hi) of blocks
    that theirs is in; ``own`` is their block."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_k"))
    placed = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    paired = placed.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    return paired.withColumn("lo", F.least("own", "_with")).withColumn("hi", F.greatest("own", "_with")).drop("_with")


def alike(members: DataFrame, least: float, percent: int, block: int = 1024) -> DataFrame:
    """A forest (a, b) that spans, bucket by bucket, the pairs not yet checked whose signatures are alike.

    ``members``: (bucket, node, component, n, sig, pivot).  Pairs in one component, pairs with the pivot and
    pairs too unlike in size are settled.  A task emits fewer rows than it has members.
    """

    def compare(t: pa.Table) -> pa.Table:
        own, lo, hi = t.column("own").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        node, comp, n = (t.column(c).to_numpy() for c in ("node", "component", "n"))
        pivot = t.column("pivot").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(node), -1)
        i, j = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        sets, found = Sets(len(node)), []
        for s in range(0, len(i), 256):
            p = i[s : s + 256]
            open_ = (comp[p][:, None] != comp[j][None, :]) & ~(pivot[p][:, None] | pivot[j][None, :])
            open_ &= np.minimum(n[p][:, None], n[j][None, :]) * 100 >= percent * np.maximum(n[p][:, None], n[j][None, :])
            on = np.flatnonzero(open_.any(axis=1))
            if len(on):
                x, y = np.nonzero(np.where(open_[on], _close(sig[p[on]], sig[j]), 0) >= least)
                found += [(u, v) for u, v in zip(p[on[x]].tolist(), j[y].tolist()) if sets.join(u, v)]
        return pa.table({"a": pa.array(node[[f[0] for f in found]] if found else [], pa.int64()), "b": pa.array(node[[f[1] for f in found]] if found else [], pa.int64())})

    rows = _in_blocks(members, "bucket", block).select("bucket", "lo", "hi", "own", "node", "component", "n", "sig", "pivot")
    return rows.groupBy("bucket", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def family_links(families: DataFrame, docs: DataFrame, width: int, percent: int, block: int = 512) -> DataFrame:
    """Links between components of one family, found on the full sets: a forest (a, b) that spans them.

    ``families``: (family, node, component).  All pairs of a family are held against each other, two
    blocks at a time; a task emits fewer links than it has members, so families of many alike but unlinked
    documents make no more rows than themselves.
    """

    def compare(t: pa.Table) -> pa.Table:
        own, lo, hi = t.column("own").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        node, comp, texts = t.column("node").to_numpy(), t.column("component").to_numpy(), t.column("text")
        known = WordHashes()
        each = [shingle_hashes(known.of(lower_words(x.as_py())), width) for x in texts]
        sizes = np.array([len(x) for x in each])
        every, local = np.unique(np.concatenate(each), return_inverse=True)
        ends = np.cumsum(sizes)
        ids = [local[e - k : e] for e, k in zip(ends, sizes)]
        i, j = np.flatnonzero(own == lo), np.flatnonzero((own == hi) & (sizes > 0))
        found, sets = [], Sets(len(node))
        first: dict[int, int] = {}
        for k, c in enumerate(comp.tolist()):
            sets.join(first.setdefault(c, k), k)
        if len(j):
            flat, starts = np.concatenate([ids[k] for k in j]), np.cumsum([0, *sizes[j][:-1]])
            mark = np.zeros(len(every), np.int32)
            for u in i[sizes[i] > 0].tolist():
                mark[ids[u]] = 1
                common = np.add.reduceat(mark[flat], starts)
                mark[ids[u]] = 0
                for v in j[100 * common >= percent * (sizes[u] + sizes[j] - common)].tolist():
                    if sets.root(u) != sets.root(v):
                        a, b = shingle_set(texts[u].as_py(), width), shingle_set(texts[v].as_py(), width)
                        if 100 * len(a & b) >= percent * len(a | b):
                            sets.join(u, v)
                            found.append((u, v))
        return pa.table({"a": pa.array(node[[f[0] for f in found]] if found else [], pa.int64()), "b": pa.array(node[[f[1] for f in found]] if found else [], pa.int64())})

    texts = docs.select(F.col("doc_id").alias("node"), "text")
    rows = _in_blocks(families.join(texts, "node"), "family", block).select("family", "lo", "hi", "own", "node", "component", "text")
    return rows.groupBy("family", "lo", "hi").applyInArrow(compare, "a long, b long")


def check_classes(some: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> None:
    """Hold one document of every distinct text of a class against the class's least, on the full sets.

    Sets that differ in spite of equal fingerprints (128 bits and the size) are an error.
    """
    texts = some.groupBy("fp1", "fp2", "n_shingles", "text_key").agg(F.min("doc_id").alias("b"))
    pairs = materialize(texts.join(sets, ["fp1", "fp2", "n_shingles"]).where("b <> node").select(F.col("node").alias("a"), "b").distinct(), "variants")
    same = confirmed(pairs, docs, width, 100).distinct().count()
    if same != (n := pairs.count()):
        raise RuntimeError(f"{n - same} documents have another's fingerprints and other shingles")
    discard(pairs)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, bands: int = 48, rows: int = 5, margin: float = 0.15) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing.  Equal
    rows are in one class.  doc_id is the identity of a document; a null doc_id gets its class's least
    doc_id, or null.  A pair at the limit of 0.75 is missed by all 48 bands of 5 with a chance of 2e-6; a
    linked pair's share of equal minima falls ``margin`` below the limit with less than 1e-6.
    """
    signed = materialize(signatures(docs, width, bands * rows), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    sets = materialize(some.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    check_classes(some, sets, docs, width)
    # One row for each class: its least document's (repeated rows of it are alike).
    own = some.select(F.col("doc_id").alias("node"), "fp1", "fp2", "n_shingles", "sig").join(sets, ["node", "fp1", "fp2", "n_shingles"], "left_semi")
    classes = own.groupBy("node", "n_shingles").agg(F.first("sig").alias("sig"))
    classes = materialize(classes, "class-signatures")

    spread = band_rows(classes, bands, rows)
    shared = spread.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("size")).where("pivot < last")
    buckets = materialize(spread.join(shared.select("bucket", "pivot", "size"), "bucket"), "buckets")
    sizes = buckets.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("p")).select("bucket", F.col("p.n").alias("pn"))
    star = buckets.where("node <> pivot").join(sizes, "bucket").where(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")
    pairs = star.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(confirmed(pairs, docs, width, percent), "links")

    tied = materialize(connected_components(links), "components")
    named = buckets.where("size > 2").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("bucket")
    rest = named.join(mixed, "bucket").withColumn("pivot", F.col("node") == F.col("pivot"))
    rest = rest.join(classes.select("node", "sig"), "node").select("bucket", "node", "component", "n", "sig", "pivot")
    likely = materialize(alike(rest, percent / 100 - margin, percent), "alike")
    if not likely.isEmpty():
        family = connected_components(likely).withColumnRenamed("component", "family")
        families = family.join(tied, "node", "left").select("family", "node", F.coalesce("component", "node").alias("component"))
        links = materialize(family_links(families, docs, width, percent), "links")
        stars = tied.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        tied = materialize(connected_components(stars.union(links)), "components")

    members = sets.join(tied, "node", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    full = signed.drop("sig", "text_key").where("n_shingles > 0").join(members, ["fp1", "fp2", "n_shingles"], "left")
    empty = signed.drop("sig", "text_key").where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return full.select("doc_id", "n_shingles", "component_id").union(empty.select("doc_id", "n_shingles", "component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
