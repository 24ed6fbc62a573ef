"""Learned parts: factorisation, text vectors, a ridge map; and a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.functions.vectors import l2_normalised
from frostline.sources.storage import stored


#: Ratings of a block of users or items in ``factorised``, about: a task builds and sorts those of a block.
RATINGS = 4_000_000


def als_blocks(n: int) -> int:
    """Blocks of each side for n ratings: ten, as by default, up to 40 million, and then so many that a block doesn't grow."""
    return max(10, -(-n // RATINGS))


def factorised(pairs: DataFrame, rank: int = 16, rounds: int = 5, seed: int = 42):
    """Implicit alternating least squares over interactions: the fitted model."""
    from pyspark.ml.recommendation import ALS

    rows = pairs.select(F.col("user_id").cast("int").alias("user"), F.col("item_id").cast("int").alias("item"), F.lit(1.0).alias("r"))
    rows = stored(rows)
    blocks = als_blocks(rows.count())
    return ALS(numUserBlocks=blocks, numItemBlocks=blocks, userCol="user", itemCol="item", ratingCol="r", implicitPrefs=True, rank=rank, maxIter=rounds, seed=seed, coldStartStrategy="drop").fit(rows)


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): counts of words of two characters or more times ln((1+n)/(1+df))+1, unit length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2)
    tf = docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.count()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df, "term").withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n) / (1.0 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def ridge_map(rows: DataFrame, x: str, y: str, penalty: float = 1.0) -> np.ndarray:
    """Least squares from vectors x (and a bias, unpenalised) to vectors y by summed products.

    The sums are taken in Spark; the system to solve is as large as a vector.
    """

    def sums(batches):
        import pandas as pd

        for pdf in batches:
            a = np.column_stack([np.stack(pdf["x"]), np.ones(len(pdf))])
            b = np.stack(pdf["y"])
            yield pd.DataFrame({"m": [np.concatenate([(a.T @ a).ravel(), (a.T @ b).ravel()])]})

    parts = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(sums, "m array<double>")
    total = parts.select(F.posexplode("m").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()
    d = rows.select(F.size(x).alias("d"), F.size(y).alias("e")).first()
    n, e = d["d"] + 1, d["e"]
    left, right = total[: n * n].reshape(n, n), total[n * n :].reshape(n, e)
    return np.linalg.solve(left + penalty * np.diag([1.0] * (n - 1) + [0.0]), right)


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str]], list[float]], prompt: Column) -> DataFrame:
    """Add ``predict``, six decimals as text, of a scorer of prompts that tasks call batch by batch."""

    def run(batches):
        for pdf in batches:
            pdf["predict"] = [f"{p:.6f}" for p in scorer(pdf["prompt"].tolist())]
            yield pdf

    ready = pairs.withColumn("prompt", prompt)
    return ready.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields) + ", predict string")


def stub_scorer(prompts: list[str]) -> list[float]:
    """A stand-in for a language model: the same number for the same prompt."""
    import hashlib

    return [int(hashlib.md5(p.encode()).hexdigest()[:8], 16) / 2**32 for p in prompts]


def mapped(vectors: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(id, v) through linear layers (weights, one row an output, and biases) with max(0, x) between them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            for k, (w, b) in enumerate(layers):
                x = (np.maximum(x, 0) if k else x) @ w.T + b
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float64()))], ["id", "v"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<double>")


def vector_rows(columns: dict, name: str, x: np.ndarray):
    """An Arrow batch of some columns and of a matrix's rows as lists."""
    import pyarrow as pa

    at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32())
    lists = pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))
    return pa.RecordBatch.from_arrays([*columns.values(), lists], [*columns, name])


def summed_vectors(rows: DataFrame, by: str = "id", partial: bool = True) -> DataFrame:
    """(by, n, v): the number and the sum of each id's vectors of (by long, v array<double>).

    A task adds up what it meets of an id in a batch before anything is shuffled, so that an id with very many
    rows sends one row a batch; what arrives is sorted by id and added up run by run.  Where a task has each id once
    (``partial`` False) there is nothing to add up before, and rows don't go through Python for it.
    """
    import pyarrow as pa

    schema = f"{by} long, n long, v array<double>"

    def add(ids: np.ndarray, n: np.ndarray, x: np.ndarray):
        keys, at = np.unique(ids, return_inverse=True)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(keys)))
        return keys, np.add.reduceat(n[order], starts), np.add.reduceat(x[order], starts, axis=0)

    def batch_of(keys, n, x):
        return vector_rows({by: pa.array(keys), "n": pa.array(n)}, "v", x)

    def arrays(batch):
        n = batch.column("n").to_numpy() if "n" in batch.schema.names else np.ones(batch.num_rows, np.int64)
        return batch.column(by).to_numpy(), n, batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)

    def some_of(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch_of(*add(*arrays(batch)))

    def final(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n, x = arrays(batch)
            if held is not None:
                ids, n, x = np.append(held[0], ids), np.append(held[1], n), np.concatenate([held[2], x])
            keys, n, x = add(ids, n, x)
            if len(keys) > 1:
                yield batch_of(keys[:-1], n[:-1], x[:-1])
            held = keys[-1:], n[-1:], x[-1:]
        if held is not None:
            yield batch_of(*held)

    some = rows.where(f"{by} is not null and v is not null").select(F.col(by).cast("long").alias(by), "v")
    some = some.mapInArrow(some_of, schema) if partial else some
    return some.repartition(by).sortWithinPartitions(by).mapInArrow(final, schema)


def mean_vectors(rows: DataFrame) -> DataFrame:
    """(id, v): the mean of each id's vectors."""
    return summed_vectors(rows).select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def embedded(docs: DataFrame, embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(id, v): an embedder's vectors of texts, which tasks call batch by batch; a null text is an empty one."""

    def run(batches):
        for pdf in batches:
            pdf["v"] = list(np.asarray(embedder(pdf["text"].fillna("").tolist()), float).reshape(len(pdf), -1))
            yield pdf[["id", "v"]]

    return docs.select("id", "text").mapInPandas(run, "id long, v array<double>")


def hashed_words(dim: int) -> Callable[[list[str]], np.ndarray]:
    """The default embedder: each word adds 1 or -1 to a component, both by hash; vectors have unit length."""
    import hashlib
    import re

    def embed(texts: list[str]) -> np.ndarray:
        number = lambda w, seed: int(hashlib.md5(f"{seed}:{w}".encode()).hexdigest()[:8], 16)
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for w in re.split(r"[^\w]+", text.lower()):
                if len(w) >= 2:
                    row[number(w, "v") % dim] += 1 - 2 * (number(w, "w") % 2)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def text_factors(docs: DataFrame, dim: int, least: int = 512, most: int = 16_384, rounds: int = 12, seed: int = 3) -> DataFrame:
    """(id, v): TF-IDF of words and pairs of words without stop words, on its first singular vectors, of unit length.

    The vocabulary has eight terms a document, ``least`` at least and ``most`` at most: the commonest.  Where
    there are fewer singular vectors than ``dim``, the rest is zeros.  The vectors come from a random subspace that
    ``rounds`` passes over the documents turn towards them; a pass adds up a matrix of terms by dimensions.
    """
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StopWordsRemover
    from pyspark.ml.functions import vector_to_array

    words = RegexTokenizer(inputCol="text", outputCol="raw", pattern=r"\W+", minTokenLength=2).transform(docs.select("id", F.coalesce("text", F.lit("")).alias("text")))
    words = NGram(inputCol="words", outputCol="two").transform(StopWordsRemover(inputCol="raw", outputCol="words").transform(words))
    terms = words.select("id", F.concat("words", "two").alias("terms"))
    n = docs.count()
    counts = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=min(max(8 * n, least), most)).fit(terms).transform(terms)
    weighed = IDF(inputCol="tf", outputCol="x").fit(counts).transform(counts)
    # Non-zero weights and their terms; a document has few of the vocabulary's.
    sparse = F.expr("filter(transform(a, (x, i) -> struct(i as t, x as w)), s -> s.w <> 0)")
    rows = stored(weighed.select("id", vector_to_array("x").alias("a")).select("id", F.size("a").alias("size"), sparse.alias("s")).select("id", "size", F.col("s.t").alias("t"), F.col("s.w").alias("w")))
    size = (rows.agg(F.max("size")).first()[0] or 0) if n else 0
    k = max(1, min(dim, size, n - 1))
    axes = _top_axes(rows, size, k, rounds, seed) if size else np.zeros((0, k))
    v = _times(rows, axes).select("id", F.concat("v", F.array_repeat(F.lit(0.0), dim - k)).alias("v"))
    return v.select("id", l2_normalised("v").alias("v"))


def _sparse_batch(batch, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of a batch's non-zero weights, and its rows times ``axes``."""
    t, w = batch.column("t"), batch.column("w")
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(t.offsets)))
    term, weight = t.flatten().to_numpy().astype(np.int64), w.flatten().to_numpy()
    out = np.zeros((batch.num_rows, axes.shape[1]))
    np.add.at(out, row, weight[:, None] * axes[term])
    return row, term, weight, out


def _times(rows: DataFrame, axes: np.ndarray) -> DataFrame:
    import pyarrow as pa

    sent = rows.sparkSession.sparkContext.broadcast(axes)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(_sparse_batch(batch, sent.value)[3]), pa.list_(pa.float64()))], ["id", "v"])

    return rows.select("id", "t", "w").mapInArrow(run, "id long, v array<double>")


def _top_axes(rows: DataFrame, size: int, k: int, rounds: int, seed: int) -> np.ndarray:
    """The first k right singular vectors of sparse rows (t, w) over ``size`` terms, by subspace iteration."""
    import pyarrow as pa

    spare = min(size, k + 10)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, spare)))[0]
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(q)

        def run(batches, sent=sent):
            total = np.zeros((size, spare))
            for batch in batches:
                row, term, weight, y = _sparse_batch(batch, sent.value)
                np.add.at(total, term, weight[:, None] * y[row])
            met = np.flatnonzero(total.any(axis=1))
            for a in range(0, len(met), 1_000):
                yield pa.RecordBatch.from_arrays([pa.array(met[a : a + 1_000]), pa.array(list(total[met[a : a + 1_000]]), pa.list_(pa.float64()))], ["id", "v"])

        found = summed_vectors(rows.select("t", "w").mapInArrow(run, "id long, v array<double>"), "id").collect()  # a row a term
        sent.unpersist()
        product = np.zeros((size, spare))
        for r in found:
            product[r.id] = r.v
        q, r = np.linalg.qr(product)
    u, _, _ = np.linalg.svd(r)  # the subspace's own axes, the strongest first
    return (q @ u)[:, :k]


def gaussian_rows(terms: list[str], dim: int, seed: int | str) -> np.ndarray:
    """Rows of a random matrix by term: entries are normal by md5 (Box and Muller), of variance 1 / dim, made when asked for."""
    import hashlib

    raw = b"".join(hashlib.md5(f"{seed}:{t}-{k}".encode()).digest()[:8] for t in terms for k in range(dim))
    h = np.frombuffer(raw, ">u4").astype(float).reshape(len(terms), dim, 2)
    return np.sqrt(-2 * np.log((h[..., 0] + 0.5) / 2**32)) * np.cos(2 * np.pi * h[..., 1] / 2**32) / np.sqrt(dim)


def projected(weights: DataFrame, dim: int = 128, seed: int | str = 42, most_terms: int = 20_000) -> DataFrame:
    """(id, v) of unit length: sparse (id, term, weight) times a random matrix that is never stored.

    A row of the matrix is made by hash from its term wherever a weight lies; a task remembers the rows of the last
    ``most_terms`` terms, and adds up what it meets of an id before anything is shuffled.
    """
    import pyarrow as pa

    def run(batches):
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            terms = batch.column("term").to_pylist()
            if len(known) > most_terms:
                known = {}
            new = list(set(terms).difference(known))
            known.update(zip(new, gaussian_rows(new, dim, seed)))
            ids, at = np.unique(batch.column("id").to_numpy(), return_inverse=True)
            order = np.argsort(at, kind="stable")
            x = np.stack([known[t] for t in terms]) * batch.column("weight").to_numpy()[:, None]
            sums = np.add.reduceat(x[order], np.searchsorted(at[order], np.arange(len(ids))), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(sums), pa.list_(pa.float64()))], ["id", "v"])

    rows = weights.select(F.col("id").cast("long").alias("id"), "term", F.col("weight").cast("double").alias("weight")).where("id is not null and term is not null and weight <> 0")
    sums = summed_vectors(rows.mapInArrow(run, "id long, v array<double>"), "id")
    return sums.select("id", l2_normalised("v").alias("v"))


def pooled(tokens: DataFrame, mode: str = "mean", most: int = 128) -> DataFrame:
    """(id, v): one vector of each id's token vectors (id, pos, mask, v) among its first ``most`` positions.

    ``mean``: of the unmasked ones, zeros where all are masked; ``last``: the unmasked one of greatest pos, and no row
    where all are masked.  Means are added up task by task before the shuffle; of last ones a task sends one an id.
    """
    rows = tokens.where(F.col("pos") < most).select(F.col("id").cast("long").alias("id"), "pos", F.coalesce(F.col("mask") > 0, F.lit(False)).alias("on"), F.col("v").cast("array<double>").alias("v"))
    if mode == "last":
        return rows.where("on").groupBy("id").agg(F.max_by("v", "pos").alias("v"))
    if mode != "mean":
        raise ValueError(f"unknown mode: {mode}")
    zeros = F.transform("v", lambda x: F.lit(0.0))
    ones = rows.select("id", F.when(F.col("on"), F.concat("v", F.array(F.lit(1.0)))).otherwise(F.concat(zeros, F.array(F.lit(0.0)))).alias("v"))
    sums = summed_vectors(ones, "id")
    n = F.greatest(F.element_at("v", -1), F.lit(1.0))
    return sums.select("id", F.transform(F.slice("v", 1, F.size("v") - 1), lambda x: x / n).alias("v"))
