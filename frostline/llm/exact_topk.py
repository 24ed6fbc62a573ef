"""Exact top-k by inner product: no-random-access aggregation over sorted lists, block by block.

A vector's score is the sum of one contribution for each component, so each component is a sorted list
of the candidates, read from its largest values for a query with a positive component and from its
smallest for a negative one.  Vectors are turned to their block's principal axes first, which keeps all
inner products and lets few lists tell most of a score.  All lists are read to a common depth, which gives
every candidate a lower and an upper bound; lists are then read on, those that can still tell most first,
and a candidate whose upper bound lies below the k-th lower bound goes for good.  When few are left, their
scores are resolved in whole numbers.  A query's k-th score so far holds for the blocks that a task meets later.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.common import materialize, new_folder, table


class Lists:
    """Sorted lists of a block of vectors: per component, each vector's place from either end."""

    def __init__(self, x: np.ndarray, ascending: np.ndarray | None = None, from_low: np.ndarray | None = None):
        self.x, self.columns, self.squares, n = x, np.ascontiguousarray(x.T), np.einsum("ij,ij->i", x, x), len(x)
        if ascending is None:
            order = np.argsort(x, axis=0, kind="stable")
            ascending, from_low = np.take_along_axis(x, order, axis=0), np.empty(order.shape, np.int32)
            np.put_along_axis(from_low, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.ascending, self.from_low = ascending, from_low

    def bounds(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores after reading ``depth`` entries of every list."""
        n, s = len(self.x), self.ascending
        high, low = self.from_low >= n - depth, self.from_low < depth
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        lower = plus @ np.where(high, self.x, s[0]).T + minus @ np.where(low, self.x, s[-1]).T
        upper = plus @ np.where(high, self.x, s[n - depth]).T + minus @ np.where(low, self.x, s[depth - 1]).T
        return lower, upper


def principal_axes(x: np.ndarray) -> np.ndarray:
    """The candidates' principal axes, those of most weight first."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


class Block:
    """A block of candidates: whole numbers, ids, and, made when first asked for or read from a store, axes and lists."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, axes: np.ndarray | None = None, lists: Lists | None = None):
        self.x, self.ids, self.axes, self.lists = x, ids, axes, lists

    def ready(self) -> Block:
        if self.lists is None:
            self.axes = principal_axes(self.x)
            self.lists = Lists(self.x @ self.axes)
        return self

    def write(self, folder: str, name: str) -> None:
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(folder)
        raw = io.BytesIO()
        made = self.ready().lists if len(self.x) and self.x.shape[1] else None
        more = {} if made is None else {"axes": self.axes, "y": made.x, "ascending": made.ascending, "from_low": made.from_low}
        np.savez(raw, x=self.x.astype(np.int64), ids=self.ids, **more)
        with there.open_output_stream(f"{root}/{name}.npz") as f:
            f.write(raw.getbuffer())

    @staticmethod
    def read(folder: str, name: str) -> Block:
        from pyarrow import fs

        there, root = fs.FileSystem.from_uri(folder)
        with there.open_input_file(f"{root}/{name}.npz") as f:
            held = np.load(io.BytesIO(f.read()))
        lists = Lists(held["y"], held["ascending"], held["from_low"]) if "y" in held else None
        return Block(held["x"].astype(float), held["ids"], held["axes"] if lists else None, lists)


def read_on(z: np.ndarray, lists: Lists, lower: np.ndarray, upper: np.ndarray, depth: int, k: int, least: float, slack: float, few: int) -> tuple[np.ndarray, int]:
    """Candidates that a query can't do without, and the number of list entries read to know.

    ``lower`` and ``upper`` are the bounds after ``depth`` entries of every list; ``least`` is a score that k
    others are known to reach.  Lists are read to their ends, four at a time, those first whose ends lie
    farthest below what is read of them; what a list adds to a candidate replaces its upper bound.  Second
    bounds are what was added so far, less and plus the product of the lengths of what query and candidate
    have in lists that aren't read to their ends.  Where ``lower`` is minus infinity, the candidate is none.
    """
    n, d = lists.x.shape
    alive, entries, columns = np.arange(n), depth * d, lists.columns
    up, ends = z >= 0, lists.ascending
    last = z * np.where(up, ends[n - depth], ends[depth - 1])
    order = np.argsort(z * np.where(up, ends[0], ends[-1]) - last)
    added, rest, own = np.zeros(n), lists.squares, np.isneginf(lower)
    length = np.sqrt(np.append(np.cumsum(z[order[::-1]] ** 2)[::-1], 0))  # of the query in the lists from here on
    for s in range(0, d + 4, 4):
        most = length[min(s, d)] * np.sqrt(np.maximum(rest, 0))
        if len(alive) > k:
            least = max(least, np.partition(np.maximum(lower, np.where(own, -np.inf, added - most)), len(alive) - k)[len(alive) - k])
        able = np.minimum(upper, added + most) >= least - slack
        n_able = np.count_nonzero(able)
        if n_able <= few or s >= d:
            return alive[able], entries
        if 2 * n_able < len(alive):
            alive, lower, upper, added, rest, own, columns = alive[able], lower[able], upper[able], added[able], rest[able], own[able], np.compress(able, columns, axis=1)
        for j in order[s : s + 4].tolist():
            part = columns[j] * z[j]
            added = added + part
            part -= last[j]
            upper = upper + np.minimum(part, 0, out=part)
            np.multiply(columns[j], columns[j], out=part)
            rest = rest - part
        entries += (n - depth) * min(4, d - s)
    return alive, entries


def block_topk(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray | Block, ids: np.ndarray | None, k: int, least: np.ndarray | None = None, first_depth: int = 16) -> tuple[list[tuple[int, int, int]], int]:
    """(query's place, candidate's id, score) of each query's k best in the block, ties to the smaller id; entries read.

    ``least``: a score for each query that its candidates of other blocks are known to reach k times; what lies
    below may be left out.  Integers come as float64 and stay exact below 2**53.
    """
    block = x if isinstance(x, Block) else Block(x, ids)
    x, ids = block.x, block.ids
    n, out, entries = len(x), [], 0
    least = np.full(len(q), -np.inf) if least is None else least
    few = max(8 * k, n // 32)
    if n > few:
        lists, depth = block.ready().lists, max(1, n // first_depth)
        z = q @ block.axes
        lower, upper = lists.bounds(z, depth)
        lower[q_ids[:, None] == ids[None, :]] = -np.inf
        slack = 1e-9 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max())
    for row in range(len(q)):
        who = np.arange(n)
        if n > few:
            who, read = read_on(z[row], lists, lower[row], upper[row], depth, k, least[row], slack[row], few)
            entries += read
        who = who[ids[who] != q_ids[row]]
        score = x[who] @ q[row]
        best = np.lexsort((ids[who], -score))[:k]
        out += zip([row] * len(best), ids[who[best]].tolist(), score[best].astype(np.int64).tolist())
    return out, entries


def stored_blocks(vectors: DataFrame, folder: str, block: int) -> DataFrame:
    """(name, d, n, g) of blocks of at most ``block`` candidates of one length, stored with their axes and sorted lists.

    Candidates are shuffled once, for this; the files that a failed try leaves are named by no row.  ``g`` numbers blocks.
    """
    parts = max(1, -(-vectors.count() // max(1, block - block // 8)))

    def write(t: pa.Table) -> pa.Table:
        d, names, sizes = t.column("d")[0].as_py(), [], []
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(t), d).astype(float)
        ids = t.column("vec_id").to_numpy()
        for s in range(0, len(x), block):
            names.append(uuid.uuid4().hex)
            sizes.append(len(x[s : s + block]))
            Block(x[s : s + block], ids[s : s + block]).write(folder, names[-1])
        return pa.table({"name": pa.array(names, pa.string()), "d": pa.array([d] * len(names), pa.int32()), "n": pa.array(sizes, pa.int64())})

    dealt = vectors.select("vec_id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).alias("b"))
    found = materialize(dealt.groupBy("b", "d").applyInArrow(write, "name string, d int, n long"), "blocks")
    return materialize(found.withColumn("g", F.row_number().over(Window.orderBy("d", F.col("n").desc(), "name")) - 1), "numbered-blocks")  # one row a block


def search(asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, folder: str):
    """The function of a task's blocks: one after another, each query's k-th score carried on.

    ``asked``: by length of vectors, the queries' ids and vectors, and a score that each has k times elsewhere.
    """

    def run(batches):
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        least = {d: known.copy() for d, (_, _, known) in asked.items()}
        for batch in batches:
            for name, d in zip(batch.column("name").to_pylist(), batch.column("d").to_pylist()):
                if d not in asked:
                    continue
                q_ids, q, known = asked[d]
                held = Block.read(folder, name)
                if d and float(np.abs(held.x).max()) * float(np.abs(q).max()) * d >= 2**53:
                    raise OverflowError("scores beyond 2**53 aren't exact")
                for row, c, score in block_topk(q.astype(float), q_ids, held, None, k, least[d])[0]:
                    best.setdefault((d, row), []).append((-score, c))
                for (e, row), found in best.items():
                    if e == d:
                        best[d, row] = found = sorted(found)[:k]
                        if len(found) == k:
                            least[d][row] = max(known[row], -found[-1][0])
        rows = [(int(asked[d][0][row]), c, -s) for (d, row), found in best.items() for s, c in found if -s >= asked[d][2][row]]
        for i in range(0, len(rows), 100_000):
            cols = list(zip(*rows[i : i + 100_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, query_block: int = 2048, blocks_a_group: int = 4, most_bytes: int = 2**26) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of highest inner product.

    Both tables: (vec_id long, v array<long>).  A candidate with the query's vec_id is the query itself.
    Only vectors as long as the query are candidates; repeated queries count once; a null vec_id takes no
    part.  Fewer than k candidates are all returned; an empty table gives no rows.  Candidates are shuffled once,
    into blocks that are stored with their axes and sorted lists; for each block of queries (broadcast,
    ``query_block`` of them and ``most_bytes`` at most) tasks read ``blocks_a_group`` stored blocks each.  The first
    block of each length goes ahead: its k-th scores bound the search in all.
    """
    spark = vectors.sparkSession
    left, asked = vectors.where("vec_id is not null"), queries.where("vec_id is not null").dropDuplicates(["vec_id", "v"])
    longest = asked.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    rows_a_block = max(1, min(query_block, most_bytes // (8 * max(longest, 1))))
    parts = max(1, -(-asked.count() // rows_a_block))
    dealt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int")
    folder = new_folder(spark, "lists")
    blocks = stored_blocks(left, folder, block)
    n_blocks = blocks.count()
    tasks = max(1, -(-n_blocks // blocks_a_group))
    schema, stored = "query_id long, vec_id long, score long", []
    for part in range(parts):
        held: dict[int, list] = {}
        for r in asked.where(dealt == part).select("vec_id", "v").collect():  # one block of the queries
            held.setdefault(len(r["v"]), []).append(r)
        for s in range(0, max(map(len, held.values()), default=0), rows_a_block):
            some = {}
            for d, rows in held.items():
                if rows := rows[s : s + rows_a_block]:
                    some[d] = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64).reshape(len(rows), d), np.full(len(rows), -np.inf)
            if tasks > 1:
                ahead = blocks.groupBy("d").agg(F.min("g").alias("g")).select("g")
                first: dict[int, list[int]] = {}
                for r in blocks.join(ahead, "g").select("name", "d").mapInArrow(search(some, k, folder), schema).collect():
                    first.setdefault(r["query_id"], []).append(r["score"])
                for q_ids, _, known in some.values():
                    known[:] = [min(found) if len(found := first.get(i, [])) == k else -np.inf for i in q_ids.tolist()]
            spread = blocks.withColumn("t", F.pmod("g", F.lit(tasks))).repartition(tasks, "t").sortWithinPartitions("t", "g")
            found = spread.select("name", "d").mapInArrow(search(some, k, folder), schema)
            stored.append(found if parts == 1 else materialize(found, "found"))
    if not stored:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = stored[0] if len(stored) == 1 else spark.read.schema(stored[0].schema).parquet(*[s._stored_at for s in stored])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    vectors = rows.where(finite).select("vec_id", F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("long")).alias("v"))
    return exact_topk(vectors, vectors.where("vec_id % 100 = 0"))


#: The same search by SQL, over all pairs of a query and a row.
OP4_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
