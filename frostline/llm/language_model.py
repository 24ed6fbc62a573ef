"""Language-model scores: deleted interpolation of n-gram estimates.

The estimates of order 2, 1 and 0 are mixed with weights that depend on how often the context was seen;
the weights are learned by expectation-maximisation on counts of training documents that are deleted
from the estimates they are held against.

Tasks work on units of consecutive documents.  A unit counts its own distinct n-grams, known by 64-bit
hashes, and sends them, sorted, to buckets by hash.  A bucket adds up what the units sent and returns to
each unit, in the order sent, how much the whole corpus has beyond the unit's own counts; most is zero
and packs away.  So each distinct n-gram of a unit is shuffled once, and no texts are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm.common import lower_words, materialize, new_folder, same_splits, table
from frostline.llm.near_dedup import _PLACES, WordHashes, _finish

#: Neither can be a word.
END, START = b"", b" "
#: Folds of crc32(doc_id) modulo 5 that are held out of training, and that are deleted from
#: the training counts to learn the weights.
FOLDS, HELD_OUT, DELETED = 5, 1, 0
_START = np.uint64(xxhash.xxh3_64_intdigest(START))
_END = np.uint64(xxhash.xxh3_64_intdigest(END))
_NONE = -999


def packed(keys: np.ndarray) -> bytes:
    """Sorted hashes as bytes: their steps, low bytes as they are, high ones, which mostly are zero, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return steps[:5].tobytes() + zlib.compress(steps[5:].tobytes(), 1)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The n hashes of ``packed``."""
    steps = np.frombuffer(raw[: 5 * n] + zlib.decompress(raw[5 * n :]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u8").ravel(), dtype=np.uint64)


class Unit:
    """Tokens of consecutive documents, their distinct n-grams and the unit's own counts."""

    def __init__(self, ids: list, texts: list, hashes: WordHashes):
        self.ids = ids
        folds = np.array([zlib.crc32(str(i).encode() if i is not None else b"") % FOLDS for i in ids])
        hashed = [np.append(hashes.of(lower_words(t)), _END) for t in texts]
        lengths = [len(w) for w in hashed]
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum([0, *lengths[:-1]])
        self.held_out = folds == HELD_OUT
        train, deleted = np.repeat(folds != HELD_OUT, lengths), np.repeat(folds == DELETED, lengths)
        self.deleted = deleted
        tokens = np.concatenate(hashed)
        del hashed
        context = np.concatenate([[_START], tokens[:-1]])
        context[self.starts] = _START
        with np.errstate(over="ignore"):
            pairs = _finish(context * _PLACES[1] + tokens * _PLACES[2])
        self.context_is_start = context == _START
        self.grams = []
        for values in (tokens, pairs):
            keys, inverse = np.unique(values, return_inverse=True)
            self.grams.append((keys, inverse, np.bincount(inverse, train, len(keys)).astype(np.uint32), np.bincount(inverse, deleted, len(keys)).astype(np.uint32)))
        self.name = f"{xxhash.xxh3_64_hexdigest(repr(ids).encode())}{xxhash.xxh3_64_hexdigest(tokens.tobytes())}"

    @staticmethod
    def edges(keys: np.ndarray, buckets: int) -> np.ndarray:
        """Where each bucket's range of hashes starts and ends in sorted keys."""
        inner = [np.uint64((k << 64) // buckets) for k in range(1, buckets)]
        return np.concatenate([[0], np.searchsorted(keys, np.array(inner, np.uint64)), [len(keys)]]).astype(np.int64)


def units(batches, most_chars: int):
    """Consecutive documents of a task, up to a bound of characters (or one longer document)."""
    hashes, ids, texts, held = WordHashes(150_000), [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids.append(i)
            texts.append(t)
            held += len(t) if t else 0
            if held >= most_chars:
                yield Unit(ids, texts, hashes)
                ids, texts, held = [], [], 0
    if ids:
        yield Unit(ids, texts, hashes)


def _count(docs: DataFrame, buckets: int, most_chars: int) -> DataFrame:
    """(bucket, unit, gram, keys, train, deleted): sorted hashes, packed, and counts as bytes."""

    def count(batches):
        for unit in units(batches, most_chars):
            rows = []
            for gram, (keys, _, train, deleted) in enumerate(unit.grams):
                at = Unit.edges(keys, buckets)
                rows += [(k, unit.name, gram, packed(keys[a:b]), train[a:b].tobytes(), deleted[a:b].tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if a < b]
            for i in range(0, len(rows), 256):
                cols = list(zip(*rows[i : i + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[3:])], ["bucket", "unit", "gram", "keys", "train", "deleted"])

    return docs.mapInArrow(count, "bucket int, unit string, gram int, keys binary, train binary, deleted binary")


def _beyond(t: pa.Table) -> pa.Table:
    """A bucket's answer to every unit: counts of the whole corpus less the unit's own.

    The row without a unit has the bucket's number of training tokens, deleted ones and distinct words.
    """
    units_, grams = t.column("unit").to_pylist(), t.column("gram").to_numpy()
    raw = {c: t.column(c).to_pylist() for c in ("keys", "train", "deleted")}
    out = {"unit": [], "bucket": [], "gram": [], "train": [], "deleted": [], "sums": []}
    bucket = t.column("bucket")[0].as_py()
    for gram in (0, 1):
        rows = np.flatnonzero(grams == gram).tolist()
        if not rows:
            continue
        parts = [unpacked(raw["keys"][r], len(raw["train"][r]) // 4) for r in rows]
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        own = {c: np.concatenate([np.frombuffer(raw[c][r], np.uint32) for r in rows]).astype(np.int64) for c in ("train", "deleted")}
        total = {c: np.bincount(inverse, own[c], len(keys)).astype(np.int64) for c in own}
        rest = {c: (total[c][inverse] - own[c]).astype(np.uint64) for c in own}
        at = 0
        for r, part in zip(rows, parts):
            out["unit"].append(units_[r])
            out["bucket"].append(bucket)
            out["gram"].append(gram)
            for c in own:
                out[c].append(zlib.compress(rest[c][at : at + len(part)].tobytes(), 1))
            out["sums"].append(None)
            at += len(part)
        if gram == 0:
            out["unit"].append(""), out["bucket"].append(bucket), out["gram"].append(0), out["train"].append(None), out["deleted"].append(None)
            out["sums"].append([int(total["train"].sum()), int(total["deleted"].sum()), int((total["train"] > 0).sum())])
    return pa.table({"unit": pa.array(out["unit"]), "bucket": pa.array(out["bucket"], pa.int32()), "gram": pa.array(out["gram"], pa.int32()), "train": pa.array(out["train"], pa.binary()), "deleted": pa.array(out["deleted"], pa.binary()), "sums": pa.array(out["sums"], pa.list_(pa.int64()))})


def _answers(folder: str, unit: Unit, buckets: int, start_counts: tuple[int, int]) -> list[dict[str, np.ndarray]]:
    """Counts of the whole corpus for the unit's n-grams: per order, all training and deleted counts."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(folder)
    files = [f.path for f in there.get_file_info(fs.FileSelector(f"{path}/unit={unit.name}", allow_not_found=True)) if f.path.endswith(".parquet")]
    if not files:
        raise RuntimeError("a task met other documents than when it counted: give a stored table, not one that is computed anew")
    got = {}
    for f in files:
        with there.open_input_file(f) as source:
            for r in pq.read_table(source).to_pylist():
                got[r["gram"], r["bucket"]] = (r["train"], r["deleted"])
    found = []
    for gram, (keys, _, train, deleted) in enumerate(unit.grams):
        at = Unit.edges(keys, buckets)
        rest = [np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)]
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if a < b:
                for into, raw in zip(rest, got[gram, k]):
                    into[a:b] = np.frombuffer(zlib.decompress(raw), np.uint64)
        found.append({"train": rest[0].astype(np.int64) + train, "deleted": rest[1].astype(np.int64) + deleted})
    return found


def _estimates(unit: Unit, counts: list[dict[str, np.ndarray]], totals: tuple[int, int, int], starts: tuple[int, int], delete: bool):
    """For each token: context bucket, bigram and unigram maximum-likelihood estimates, count of the word.

    With ``delete``, the counts are those without the deleted documents.
    """
    less = (lambda c: c["train"] - c["deleted"]) if delete else (lambda c: c["train"])
    word, pair = less(counts[0])[unit.grams[0][1]], less(counts[1])[unit.grams[1][1]]
    context = np.concatenate([[0], word[:-1]])
    context[unit.context_is_start] = starts[0] - starts[1] if delete else starts[0]
    n = totals[0] - totals[1] if delete else totals[0]
    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    return np.frexp(context.astype(float))[1], p2, word / max(n, 1), word


def _quantised(p: np.ndarray) -> np.ndarray:
    """For learning the weights only, never for scores: half octaves of a probability, so held-out counts fit a table of bounded size."""
    return np.where(p > 0, np.rint(2 * np.log2(np.maximum(p, 1e-300))), _NONE).astype(np.int64)


def learn_weights(rows: list[tuple[int, int, int, int]], uniform: float, rounds: int = 40) -> np.ndarray:
    """Mixture weights (orders 2, 1, 0) per context bucket by expectation-maximisation.

    Rows: (bucket, quantised bigram and unigram estimates, held-out count).  A bucket starts from, and is
    smoothed with one count of, the weights of all buckets together; without counts they are equal.
    """
    weights = np.full((66, 3), 1 / 3)
    if not rows:
        return weights
    bucket, q2, q1, n = np.array(rows, np.int64).T
    p = np.stack([np.where(q2 == _NONE, 0, 2.0 ** (q2 / 2)), np.where(q1 == _NONE, 0, 2.0 ** (q1 / 2)), np.full(len(n), uniform)], 1)

    def maximise(p: np.ndarray, n: np.ndarray, w: np.ndarray, prior: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            r = p * w
            r *= (n / r.sum(axis=1))[:, None]
            w = (r.sum(axis=0) + prior) / (n.sum() + prior.sum())
        return w

    every = maximise(p, n, np.full(3, 1 / 3), np.zeros(3))
    every = np.maximum(every, 1e-9) / np.maximum(every, 1e-9).sum()
    weights[:] = every
    for b in np.unique(bucket):
        on = bucket == b
        weights[b] = maximise(p[on], n[on], every, every)
    return weights


def without_context(weights: np.ndarray) -> np.ndarray:
    """Bucket 0 has the contexts that were never seen: order 2 tells nothing there, and its weight goes to the others."""
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def interpolated_scores(docs: DataFrame, stored: bool = False, most_chars: int = 5_000_000, bucket_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``stored``: the table is read from files whose order holds from one reading to the next; else it is
    written first; executors may come and go between and during readings.  Null and empty texts have the end token alone; repeated rows are each counted and
    scored; a null doc_id counts as the empty text.  Without training documents the base score of a token
    is log10(0.5 / 0.5) = 0.  Words and word pairs are told apart by 64-bit hashes.
    """
    with same_splits(docs.sparkSession):
        return materialize(_scored(docs, stored, most_chars, bucket_bytes), "scores")


def _scored(docs: DataFrame, stored: bool, most_chars: int, bucket_bytes: int) -> DataFrame:
    """``interpolated_scores`` in three passes that meet the same units, as the table is cut alike for all of them."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text") if stored else materialize(docs.select("doc_id", "text"), "texts")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = max(1, -(-size // bucket_bytes))
    folder = new_folder(spark, "counts")
    sent = _count(docs, buckets, most_chars).groupBy("bucket").applyInArrow(_beyond, "unit string, bucket int, gram int, train binary, deleted binary, sums array<long>")
    # A unit's answers are gathered in few files of its own folder.
    sent.repartition(max(1, buckets // 2), "unit").write.partitionBy("unit").mode("overwrite").parquet(folder)
    back = spark.read.schema("bucket int, gram int, train binary, deleted binary, sums array<long>, unit string").parquet(folder)
    sums = back.where("sums is not null").agg(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)).alias(f"s{k}") for k in range(3)]).first()
    totals = tuple(sums)
    folds = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    ends = docs.select(folds.alias("f")).agg(F.count(F.when(F.col("f") != HELD_OUT, 1)), F.count(F.when(F.col("f") == DELETED, 1))).first()
    starts = (ends[0], ends[1])
    uniform = 1 / (totals[2] + 1)

    def hold(batches):
        for unit in units(batches, most_chars):
            bucket, p2, p1, _ = _estimates(unit, _answers(folder, unit, buckets, starts), totals, starts, True)
            on = unit.deleted
            rows, n = np.unique(np.stack([bucket[on].astype(np.int64), _quantised(p2[on]), _quantised(p1[on])], 1), axis=0, return_counts=True) if on.any() else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(3)), pa.array(n, pa.int64())], ["bucket", "q2", "q1", "n"])

    held = docs.mapInArrow(hold, "bucket long, q2 long, q1 long, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"))
    weights = without_context(learn_weights([tuple(r) for r in held.orderBy("bucket", "q2", "q1").collect()], uniform))  # bounded by the quantised values

    def score(batches):
        for unit in units(batches, most_chars):
            bucket, p2, p1, c = _estimates(unit, _answers(folder, unit, buckets, starts), totals, starts, False)
            w = weights[bucket]
            mixed = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * uniform)
            base = np.log10((c + 0.5) / (totals[0] + 0.5 * (totals[2] + 1)))
            each = lambda v: np.add.reduceat(v, unit.starts)
            n = len(unit.ids)
            yield pa.RecordBatch.from_arrays([pa.array(unit.ids, pa.int64()), pa.array(unit.held_out), pa.array(unit.lengths), pa.array(each((c > 0).astype(np.int64))), pa.array(np.full(n, totals[0], np.int64)), pa.array(each(base)), pa.array(each(mixed))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(table(spark, sf_dir, "documents"), stored=True)
