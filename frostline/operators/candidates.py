"""Candidate retrieval: pairs of targets and pool entities by vectors or by neighbours' histories."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.sources.storage import stored

#: Rows of a block at least, bytes of a pool's and of a targets' block, products that a task makes at most.
BLOCK, POOL_BYTES, TARGET_BYTES, PRODUCTS = 2048, 2**26, 2**25, 2**33
#: Products are made in tiles of so many targets and pool rows.
ROWS, TILE = 256, 2048


def _best(a: np.ndarray, ids: np.ndarray, k: np.ndarray, b: np.ndarray, entities: np.ndarray) -> pa.Table:
    """(target, entity, score) of each row of a with its k best rows of b, by tiles: what is held is what rows keep and one tile."""
    if len(entities) > 1 and (np.diff(entities) < 0).any():
        place = np.argsort(entities, kind="stable")
        b, entities = b[place], entities[place]
    k = np.clip(k, 0, len(b)).astype(np.int64)
    parts, order, i = [], np.argsort(k, kind="stable"), 0
    while i < len(order) and len(b):
        rows = order[i : i + ROWS]
        while len(rows) > 1 and len(rows) * k[rows[-1]] > 2**20:
            rows = rows[: len(rows) // 2]
        row, entity, score = _best_of_tiles(a[rows], k[rows], b, entities)
        parts.append((ids[rows][row], entity, score))
        i += len(rows)
    cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"target": pa.array(cols[0], pa.int64()), "entity": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def _best_of_tiles(q: np.ndarray, k: np.ndarray, b: np.ndarray, entities: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, entity, score) of each row's k best; ``entities`` ascend, so a later one must beat a row's k-th score, not tie with it."""
    kth = np.where(k > 0, -np.inf, np.inf)
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    waiting = 0
    for j in range(0, len(b), TILE):
        s = q @ b[j : j + TILE].T
        low, open_ = kth + 4e-10, np.flatnonzero(np.isneginf(kth))
        if len(open_) and (most := int(k[open_].max())) < s.shape[1]:
            low[open_] = np.nextafter(np.partition(s[open_], s.shape[1] - most, axis=1)[:, s.shape[1] - most] - 2e-9, -np.inf)
        at = np.flatnonzero(s > low[:, None])
        if not len(at):
            continue
        row, col = np.divmod(at, s.shape[1])
        held.append((row, entities[j + col], np.round(s.ravel()[at], 9)))
        waiting += len(at)
        if len(open_) or waiting > max(4_096, len(held[0][0]) // 4):
            held, waiting = [_settled(held, k, kth)], 0
    return _settled(held, k, kth)


def _settled(held: list, k: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k best of what is held; ``kth`` gets the scores that later ones must beat."""
    row, entity, score = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((entity, -score, row))
    row, entity, score = row[order], entity[order], score[order]
    starts = np.searchsorted(row, np.arange(len(k) + 1))
    full = np.flatnonzero((np.diff(starts) >= k) & (k > 0))
    kth[full] = score[starts[full] + k[full] - 1]
    kept = np.arange(len(row)) - starts[row] < k[row]
    return row[kept], entity[kept], score[kept]


def _matrix(t, column: str) -> np.ndarray:
    v = t.column(column)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def _kept(df: DataFrame, *columns: str) -> DataFrame:
    """These columns of a table, stored, if it isn't already."""
    return df if getattr(df, "_stored_at", None) and df.columns == list(columns) else stored(df.select(*columns))


def _against_pool(wanted: DataFrame, pool: DataFrame, of: Callable, schema: str, block: int | None, most_bytes: int) -> DataFrame:
    """``of``(matrix of targets, their rows, matrix of the pool, its ids) of targets (id, v, ...) and a pool (id, v), both stored.

    A pool of at most ``most_bytes`` is broadcast and the targets are dealt to tasks; else both sides are cut into
    blocks by hash, and a task gets one block of each.  Blocks are as large as a task bears (``block``: rows of both), so
    few copies of either side are sent: a small side is one block, and the other is then sent once.
    """
    spark = pool.sparkSession
    size = pool.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    bytes_a_row, n = 8 * size["d"] + 8, max(1, size["n"])
    if size["n"] * bytes_a_row <= most_bytes:
        t = pool.orderBy("id").toArrow()
        held = spark.sparkContext.broadcast((_matrix(t, "v"), t.column("id").to_numpy()))

        def of_batch(batches):
            b, entities = held.value
            for batch in batches:
                if batch.num_rows and len(b):
                    yield from of(_matrix(batch, "v"), batch, b, entities).to_batches()

        tasks = max(spark.sparkContext.defaultParallelism, -(-wanted.count() * n // PRODUCTS))
        return wanted.repartition(int(tasks)).mapInArrow(of_batch, schema)
    rows_p = block or max(BLOCK, POOL_BYTES // bytes_a_row)
    rows_t = block or max(BLOCK, min(TARGET_BYTES // bytes_a_row, PRODUCTS // min(n, rows_p)))
    n_t, n_p = max(1, -(-wanted.count() // rows_t)), -(-n // rows_p)
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = wanted.withColumn("cell", F.explode(F.sequence(dealt(n_t) * n_p, dealt(n_t) * n_p + n_p - 1)))
    right = pool.select(F.col("id").alias("pool_id"), F.col("v").alias("pool_v"), F.explode(F.sequence(dealt(n_p), dealt(n_p) + (n_t - 1) * n_p, F.lit(n_p))).alias("cell"))

    def of_blocks(t: pa.Table, p: pa.Table) -> pa.Table:
        a, b = (_matrix(t, "v"), _matrix(p, "pool_v")) if len(t) and len(p) else (np.zeros((0, 1)), np.zeros((0, 1)))
        return of(a, t, b, p.column("pool_id").to_numpy())

    parts = min(2 * n_t * n_p, 20_000)
    return left.repartition(parts, "cell").groupBy("cell").cogroup(right.repartition(parts, "cell").groupBy("cell")).applyInArrow(of_blocks, schema)


def similarities(targets: DataFrame, pool: DataFrame, most: DataFrame, block: int | None = None, most_bytes: int = 2**26) -> DataFrame:
    """(target, entity, score): each target's best pool entities by inner product.

    ``targets`` and ``pool``: (id, v array<double>) with vectors of one length; ``most``: (target, k), how
    many to keep of each.  A pool of at most ``most_bytes`` is broadcast and the targets are dealt to tasks;
    else both sides are cut into blocks by hash, and a task multiplies one block with another.  Only what each
    target may need of a block is sent on.  Scores are rounded to 9 decimals, so that their order doesn't hang
    on the order of summation; ties go to the smaller id.
    """
    return _searched(targets.join(most.withColumnRenamed("target", "id"), "id").select("id", "v", "k"), pool, block, most_bytes)


def _searched(wanted: DataFrame, pool: DataFrame, block: int | None = None, most_bytes: int = 2**26) -> DataFrame:
    """``similarities`` of targets (id, v, k).  Where half of the targets or more are copies of others, each vector is searched for
    once, as deep as any of its targets needs, and each target takes the first k of its vector's list."""
    wanted, pool = stored(wanted), _kept(pool, "id", "v")
    once = stored(wanted.groupBy("v").agg(F.min("id").alias("id"), F.max("k").alias("k")).select("id", "v", "k"))
    if 2 * once.count() > wanted.count():
        return _met_pool(wanted, pool, block, most_bytes)
    members = wanted.join(once.select(F.col("id").alias("_like"), "v"), "v").select("_like", F.col("id").alias("_target"), "k")
    lists = _met_pool(once, pool, block, most_bytes)
    place = Window.partitionBy("target").orderBy(F.col("score").desc(), F.col("entity"))
    lists = stored(lists.withColumn("_place", F.row_number().over(place)))
    return lists.join(members, F.col("target") == F.col("_like")).where("_place <= k").select(F.col("_target").alias("target"), "entity", "score")


def _met_pool(wanted: DataFrame, pool: DataFrame, block: int | None, most_bytes: int) -> DataFrame:
    """(target, entity, score): at least the k best pool rows of targets (id, v, k), both tables stored.

    Where a pool beyond ``most_bytes`` has each vector twice or more, targets meet each vector once, under its smallest id.  The
    k best of those hold all vectors that a target's k best rows can have; a vector's rows, the k of smallest id, follow
    where the vectors of better scores have fewer than k rows.
    """
    best = lambda a, t, b, entities: _best(a, t.column("id").to_numpy(), t.column("k").to_numpy(), b, entities)
    schema = "target long, entity long, score double"
    size = pool.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    if size["n"] * (8 * size["d"] + 8) <= most_bytes:
        return _against_pool(wanted, pool, best, schema, block, most_bytes)
    once = stored(pool.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", "n"))
    if 2 * once.count() > size["n"]:
        return _against_pool(wanted, pool, best, schema, block, most_bytes)
    kinds = stored(pool.join(once.select(F.col("id").alias("_like"), "v", "n"), "v").select("_like", "id", "n"))
    place = Window.partitionBy("_like").orderBy("id")
    deepest = wanted.agg(F.max("k")).first()[0] or 0
    kinds = kinds.withColumn("_nth", F.row_number().over(place)).where(F.col("_nth") <= deepest)
    lists = _against_pool(wanted, _kept(once, "id", "v"), best, schema, block, most_bytes)
    sized = lists.join(once.select(F.col("id").alias("entity"), "n"), "entity").join(wanted.select(F.col("id").alias("target"), "k"), "target")
    same = Window.partitionBy("target", "score")
    # Rows of vectors of a better score: all up to this score less those of it.
    before = F.sum("n").over(Window.partitionBy("target").orderBy(F.col("score").desc())) - F.sum("n").over(same)
    needed = sized.withColumn("_before", before).where("_before < k").select("target", F.col("entity").alias("_like"), "score", "k")
    return needed.join(kinds, "_like").where("_nth <= k").select("target", F.col("id").alias("entity"), "score")


def score_rows(targets: DataFrame, columns: DataFrame, cells: int = 2**23) -> DataFrame:
    """(id, v): each target's inner products with all columns in order of ``pos``, dealt by ranges of ids and sorted by them.

    ``targets``: (id, v); ``columns``: (pos, v), at most a few thousand, which are sent to all tasks.  A task makes about
    ``cells`` products, in tiles; a product is summed component by component in their order, so its last bits are SQL's.
    """
    spark = targets.sparkSession
    t = columns.orderBy("pos").toArrow()
    held = spark.sparkContext.broadcast(np.ascontiguousarray(_matrix(t, "v").T))
    if not t.num_rows:
        targets = targets.limit(0)

    def scores(batches):
        b = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                a, out = _matrix(part, "v"), np.zeros((part.num_rows, b.shape[1]))
                for j in range(0, b.shape[1], ROWS):
                    tile = np.zeros((len(a), min(ROWS, b.shape[1] - j)))
                    for x, y in zip(a.T, b[:, j : j + ROWS]):
                        tile += x[:, None] * y
                    out[:, j : j + ROWS] = tile
                offsets = np.arange(len(a) + 1, dtype=np.int32) * b.shape[1]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(offsets, out.ravel())], ["id", "v"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-targets.count() * t.num_rows // cells))
    return targets.select("id", "v").repartitionByRange(int(tasks), "id").sortWithinPartitions("id").mapInArrow(scores, "id long, v array<double>")


def ranked(scored: DataFrame, m: int, *by: str, order: tuple[Column, ...] = ()) -> DataFrame:
    """The first m rows of each group with candidate_rank; by default by score, ties to the smaller entity."""
    place = Window.partitionBy(*by).orderBy(*(order or (F.col("score").desc(), F.col("entity"))))
    return scored.withColumn("candidate_rank", F.row_number().over(place)).where(F.col("candidate_rank") <= m)


def top_candidates(targets: DataFrame, pool: DataFrame, observed: DataFrame | None, m: int) -> DataFrame:
    """(target, entity, score, candidate_rank): the m best pool entities that a target hasn't been seen with.

    ``observed``: (target, entity), or None.  A target keeps m and as many more as it has been seen with of
    the pool, so m are left when those are taken out.
    """
    pool = _kept(pool, "id", "v")
    if observed is None:
        return ranked(_searched(targets.select("id", "v", F.lit(m).cast("long").alias("k")), pool), m, "target")
    seen = stored(observed.select("target", "entity").join(pool.select(F.col("id").alias("entity")), "entity", "left_semi").select("target", "entity").distinct())
    degree = seen.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("d"))
    wanted = targets.join(degree, "id", "left").select("id", "v", (F.coalesce("d", F.lit(0)) + m).cast("long").alias("k"))
    found = _searched(wanted, pool).select("target", "entity", "score", F.lit(False).alias("hidden"))
    # One exchange by target serves both what is taken out and the order.
    both = found.union(seen.select("target", "entity", F.lit(None).cast("double"), F.lit(True))).repartition("target")
    left = both.groupBy("target", "entity").agg(F.max("score").alias("score"), F.max("hidden").alias("hidden")).where("not hidden")
    return ranked(left.select("target", "entity", "score"), m, "target")


def neighbours(targets: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(target, neighbour, score, rank): the k most similar pool entities other than the target itself."""
    most = targets.select(F.col("id").alias("target"), F.lit(k + 1).cast("long").alias("k"))
    others = similarities(targets, pool, most).where("target <> entity")
    return ranked(others, k, "target").select("target", F.col("entity").alias("neighbour"), "score", F.col("candidate_rank").alias("rank"))


def from_neighbours(near: DataFrame, edges: DataFrame, observed: DataFrame, how: str = "sum", m: int = 20) -> DataFrame:
    """Candidates that a target's neighbours were seen with, by the sum or the largest of their similarities.

    ``edges``: (neighbour, entity) of training; ``observed``: (target, entity).  Similarities below 0 count
    as 0, and a candidate may score 0.
    """
    value = F.greatest("score", F.lit(0.0))
    summed = near.join(edges, "neighbour").join(observed, ["target", "entity"], "left_anti").groupBy("target", "entity")
    agg = F.sum(value) if how == "sum" else F.max(value)
    return ranked(summed.agg(F.round(agg, 9).alias("score")), m, "target")


def neighbour_features(near: DataFrame, edges: DataFrame, observed: DataFrame) -> DataFrame:
    """Six features of a (target, entity) from its neighbours of positive similarity."""
    s = F.col("score")
    rows = near.where("score > 0").join(edges, "neighbour").join(observed, ["target", "entity"], "left_anti")
    return rows.groupBy("target", "entity").agg(
        F.sum(s).alias("s"), F.max(s).alias("mx"), F.count("*").alias("c"), F.sum(s / F.log2(F.col("rank") + 1)).alias("decay"), F.sum(s * s).alias("sq"), F.sum(F.sqrt(s)).alias("root")
    )


#: Names of the ways to score neighbour features.
POLICIES = ("sum", "max", "avg", "count", "rank_decay", "sum_sq", "sum_sqrt", "sum_count_boost", "sum_idf025", "sum_idf050", "sum_idf100", "sum_pop025", "sum_pop050")


def policy_scores(features: DataFrame, popularity: DataFrame) -> DataFrame:
    """Long form (target, entity, policy, score), and k where there is one, of thirteen ways to score neighbour features."""
    f = features.join(popularity, "entity", "left").withColumn("p", F.log1p(F.greatest(F.coalesce("pop", F.lit(0)), F.lit(1)).cast("double")))
    s, c, p = F.col("s"), F.col("c"), F.col("p")
    scores = {
        "sum": s, "max": F.col("mx"), "avg": s / F.greatest(c, F.lit(1)), "count": c + 1e-6 * s, "rank_decay": F.col("decay"), "sum_sq": F.col("sq"), "sum_sqrt": F.col("root"),
        "sum_count_boost": s * F.log1p(c.cast("double")), "sum_idf025": s / F.pow(p, 0.25), "sum_idf050": s / F.pow(p, 0.5), "sum_idf100": s / p, "sum_pop025": s * F.pow(p, 0.25), "sum_pop050": s * F.pow(p, 0.5),
    }
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), F.round(v.cast("double"), 9).alias("score")) for k, v in scores.items()])).alias("x")
    keys = [c for c in ("k", "target", "entity") if c in features.columns]
    return f.select(*keys, long).select(*keys, "x.policy", "x.score")


def popularity_backfill(candidates: DataFrame, targets: DataFrame, popular: DataFrame, observed: DataFrame, m: int, *more: str) -> DataFrame:
    """Fill targets with fewer than m candidates from the most popular entities, at score 0.

    ``popular``: (entity, pop_rank from 1).  Targets are lists of ``id`` and, where candidates have them, of ``more``
    columns; ``observed``: (target, entity).  Only targets that lack rows ask for popular entities, by rank: those as
    far as m plus the number that the target has been seen with or has already, which is as far as it can need.
    """
    keys = ["target", *more]
    lists = targets.select(F.col("id").alias("target"), *more).distinct()
    some = candidates.groupBy(*keys).agg(F.count("*").alias("_n"))
    short = stored(lists.join(some, keys, "left").where(F.coalesce("_n", F.lit(0)) < m).select(*keys))
    held = candidates.select(*keys, "entity").join(short, keys).union(short.join(observed, "target").select(*keys, "entity")).distinct()
    need = short.join(held.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left")
    asked = need.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_n", F.lit(0)) + m)).alias("pop_rank"))
    extra = asked.join(popular.select(F.col("pop_rank").cast("long").alias("pop_rank"), "entity"), "pop_rank").select(*keys, "entity", "pop_rank")
    fresh = extra.join(held, [*keys, "entity"], "left_anti")
    both = candidates.select(*keys, "entity", "score", F.lit(0).alias("source"), F.lit(0).cast("long").alias("pop_rank")).union(fresh.select(*keys, "entity", F.lit(0.0), F.lit(1), "pop_rank"))
    order = (F.col("source"), F.col("score").desc(), F.col("pop_rank"), F.col("entity"))
    return ranked(both, m, *keys, order=order).select(*keys, "entity", "score", "source", "candidate_rank")


def score_moments(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """(target, mean, sd): of each target's inner products with the whole pool, sample deviation, without making them.

    The pool's sums of components and of their products are taken in Spark; they are as large as a vector
    and its square.
    """
    spark, d = targets.sparkSession, pool.select(F.max(F.size("v"))).first()[0] or 0

    def sums(batches):
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), batch.column("v").flatten().to_numpy().reshape(-1, d)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    parts = pool.select("v").mapInArrow(sums, "m array<double>").select(F.posexplode("m").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
    total = spark.sparkContext.broadcast(np.array([r["x"] for r in parts.orderBy("k").collect()]).reshape(d + 1, d + 1) if d else np.zeros((1, 1)))

    def moments(batches):
        t = total.value
        n = max(t[0, 0], 1.0)
        for batch in batches:
            q = batch.column("v").flatten().to_numpy().reshape(-1, d)
            mean = q @ t[0, 1:] / n
            squares = np.einsum("ij,jk,ik->i", q, t[1:, 1:] - np.outer(t[0, 1:], t[0, 1:]) / n, q)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(mean), pa.array(np.sqrt(np.maximum(squares, 0) / max(n - 1, 1.0)))], ["target", "mean", "sd"])

    return targets.select("id", "v").mapInArrow(moments, "target long, mean double, sd double")


def rounded_moments(targets: DataFrame, pool: DataFrame, block: int | None = None, most_bytes: int = 2**26) -> DataFrame:
    """``score_moments`` of scores rounded to nine decimals: a task makes those of its rows by tiles, and sends three sums of each target on.

    Pool rows of one vector are one row of their number.
    """

    def sums(a: np.ndarray, t, b: np.ndarray, n: np.ndarray) -> pa.Table:
        out = np.zeros((len(a), 2))
        for i in range(0, len(a), ROWS):
            for j in range(0, len(b), TILE):
                x = np.round(a[i : i + ROWS] @ b[j : j + TILE].T, 9)
                out[i : i + ROWS, 0] += x @ n[j : j + TILE]
                out[i : i + ROWS, 1] += np.square(x, out=x) @ n[j : j + TILE]
        return pa.table({"target": t.column("id").to_numpy()[: len(a)], "n": np.full(len(a), n.sum()), "s": out[:, 0], "q": out[:, 1]})

    once = stored(pool.groupBy("v").agg(F.count("*").alias("id")).select("id", "v"))
    parts = _against_pool(_kept(targets, "id", "v"), once, sums, "target long, n long, s double, q double", block, most_bytes)
    total = parts.groupBy("target").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return total.select("target", mean.alias("mean"), F.sqrt(F.greatest((F.col("q") - F.col("s") * mean) / F.greatest(F.col("n") - 1, F.lit(1)), F.lit(0.0))).alias("sd"))


def standardised_candidates(targets: DataFrame, pool: DataFrame, observed: DataFrame | None, m: int, digits: int = 6, more: int = 8) -> DataFrame:
    """(target, entity, score, candidate_rank): the m best by scores standardised over the whole pool and rounded, ties to the smaller entity.

    Rounding ties scores that lie close together.  A search that brings ``more`` than m rows settles a target whose
    last row lies below its m-th; targets where it doesn't are searched again, four times as deep, until all their ties
    are there or the pool ends.
    """
    moments = stored(rounded_moments(targets, pool))
    left, deep, out = stored(targets.select("id", "v")), m + more, None
    while True:
        top = standardised(top_candidates(left, pool, observed, deep).drop("candidate_rank"), moments).withColumn("score", F.round("score", digits))
        top = stored(ranked(top, deep, "target"))
        last = top.groupBy("target").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.min(F.when(F.col("candidate_rank") == m, F.col("score"))).alias("mth"))
        open_ = stored(last.where((F.col("n") == deep) & (F.col("low") == F.col("mth"))).select("target"))
        found = top.join(open_, "target", "left_anti").where(F.col("candidate_rank") <= m)
        out = found if out is None else out.union(found)
        if open_.isEmpty():
            return out
        left, deep = stored(left.join(open_, left["id"] == open_["target"], "left_semi")), 4 * deep


def standardised(scored: DataFrame, moments: DataFrame) -> DataFrame:
    """Scores less their target's mean, over its deviation or 1e-6."""
    return scored.join(moments, "target").withColumn("score", (F.col("score") - F.col("mean")) / F.greatest("sd", F.lit(1e-6))).drop("mean", "sd")


def hybrid_vectors(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, v): two vectors of an id as one, whose inner products are the sums of both."""
    return first.join(second.select("id", F.col("v").alias("_w")), "id").select("id", F.concat("v", "_w").alias("v"))


def scaled_vectors(vectors: DataFrame, moments: DataFrame) -> DataFrame:
    """Target vectors over their scores' deviation: their inner products are standardised scores plus a constant of the target."""
    return vectors.join(moments.withColumnRenamed("target", "id"), "id").select("id", F.transform("v", lambda x: x / F.greatest(F.col("sd"), F.lit(1e-6))).alias("v"))


def sized_features(near: DataFrame, edges: DataFrame, observed: DataFrame, sizes: list[int]) -> DataFrame:
    """``neighbour_features`` for several numbers of neighbours ``k``, from one join."""
    s = F.col("score")
    rows = near.where("score > 0").withColumn("k", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda k: k >= F.col("rank"))))
    rows = rows.join(edges, "neighbour").join(observed, ["target", "entity"], "left_anti")
    return rows.groupBy("k", "target", "entity").agg(F.sum(s).alias("s"), F.max(s).alias("mx"), F.count("*").alias("c"), F.sum(s / F.log2(F.col("rank") + 1)).alias("decay"), F.sum(s * s).alias("sq"), F.sum(F.sqrt(s)).alias("root"))


def z_scored(scored: DataFrame, by: str = "target") -> DataFrame:
    """Scores standardised within a group: sample deviation, at least 1e-6."""
    w = Window.partitionBy(by)
    return scored.withColumn("score", (F.col("score") - F.avg("score").over(w)) / F.greatest(F.coalesce(F.stddev_samp("score").over(w), F.lit(0.0)), F.lit(1e-6)))
