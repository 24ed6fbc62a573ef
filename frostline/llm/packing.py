"""Best-fit packing of token pieces into sequences by a configuration linear program.

The histogram of piece lengths has at most ``capacity`` entries, whatever the corpus.  A covering
linear program over configurations (multisets of lengths that fit one sequence) is solved on it by
multiplicative weights: lengths that lag behind gain weight, and a knapsack dynamic program prices
each length's best configuration for those weights.  The solution has whole sequences, and what it
leaves of the histogram is packed best-fit, longest first, length class by length class.  Pieces then
find their sequence from their rank within their length, by Spark.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.common import materialize
from frostline.llm.encoding import encoder, slices

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, drops_space: bool = False, specials: bool = False) -> DataFrame:
    """Encode every text, append ``end_id`` and cut documents longer than ``capacity``.

    All pieces of a cut document but the first have ``capacity`` ids.  Null and empty texts become the
    end id alone.  Other columns are ignored, repeated rows are all kept.  With ``specials``, strings of
    special tokens in a text become those tokens.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        enc = encoder(vocabulary, drops_space, specials)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in slices(texts):
                at, cols = [], ([], [], [], [])
                for i, raw in enumerate(enc.encode(texts[a:b]), a):
                    raw += end
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                        at.append(i)
                        for col, v in zip(cols, (k, s, e - s, zlib.crc32(raw[4 * s : 4 * e]))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE)


def fills(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming, for every room up to ``capacity``: the size to take last, and the most room (-1: none) where one is taken."""
    best, pick, at = np.zeros(capacity + 1), np.full(capacity + 1, -1), np.full(capacity + 1, -1)
    for c in range(int(sizes[0]), capacity + 1):
        n = np.searchsorted(sizes, c, "right")
        gain = value[:n] + best[c - sizes[:n]]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], pick[c], at[c] = gain[k], k, c
        else:
            best[c], at[c] = best[c - 1], at[c - 1]
    return pick, at


def filled(sizes: list[int], pick: list[int], at: list[int], room: int) -> dict[int, int]:
    """How often each size is used in the most valuable filling of a room."""
    used: dict[int, int] = {}
    while room > 0 and at[room] > 0:
        k = pick[at[room]]
        used[k] = used.get(k, 0) + 1
        room = at[room] - sizes[k]
    return used


def price(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is used in the most valuable sequence."""
    pick, at = fills(sizes, value, capacity)
    used = np.zeros(len(sizes), np.int64)
    for k, n in filled(sizes.tolist(), pick.tolist(), at.tolist(), capacity).items():
        used[k] = n
    return used


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 240, step: float = 0.02, bias: float = 0.3) -> list[tuple[dict[int, int], int]]:
    """Multiplicative weights for: cover every length's demand with as few configurations as can be.

    A round prices fillings of all rooms at once, and every length that still has pieces, the longest first, uses its best
    configuration for ``step`` of its demand, one sequence at least; covered lengths lose weight exponentially.  A
    configuration that pieces left can't make, or that leaves room, waits for another round's weights.  Amounts are
    whole sequences and never exceed a demand.
    """
    eta = np.log(len(sizes) + 1.0) / (4 * step)
    left, plain = demand.astype(np.int64).tolist(), sizes.tolist()
    share = np.maximum(1, (step * demand).astype(np.int64)).tolist()
    found: dict[tuple, int] = {}
    for _ in range(rounds):
        # A length's worth: its share of a sequence, more where its demand lags behind.  Long pieces
        # start dearer by ``bias``, as few configurations can take them, and short ones fill what is left.
        open_ = np.array(left)
        if not open_.any():
            break
        covered = 1 - open_ / demand
        weight = sizes * (1 + bias * sizes / capacity) * np.exp(-eta * step * (covered - covered.min()))
        weight[open_ == 0] = 0
        pick, at = (x.tolist() for x in fills(sizes, weight, capacity))
        for k in range(len(plain) - 1, -1, -1):
            if not left[k]:
                continue
            used = filled(plain, pick, at, capacity - plain[k])
            used[k] = used.get(k, 0) + 1
            if sum(plain[j] * n for j, n in used.items()) < capacity:
                continue
            amount = min(max(1, share[k] // used[k]), *(left[j] // n for j, n in used.items()))
            if amount:
                config = tuple(sorted(used.items()))
                found[config] = found.get(config, 0) + amount
                for j, n in used.items():
                    left[j] -= n * amount
    return [(dict(config), amount) for config, amount in found.items()]


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first, of whole length classes: (configuration, number of sequences)."""
    rooms: dict[int, dict[tuple, int]] = {}  # room left -> open configurations and how many of each
    for size, count in sorted(zip(sizes.tolist(), counts.tolist()), reverse=True):
        room = size
        while count and room <= capacity:
            if room not in rooms or not rooms[room]:
                room += 1
                continue
            config, n = next(iter(rooms[room].items()))
            each = min(room // size, count)
            n = min(n, count // each)
            rooms[room][config] -= n
            if not rooms[room][config]:
                del rooms[room][config]
            to = rooms.setdefault(room - each * size, {})
            grown = (*config, (size, each))
            to[grown] = to.get(grown, 0) + n
            count -= n * each
        each = capacity // size
        for k, n in ((each, count // each), (count % each, 1)):
            if k and n:
                to = rooms.setdefault(capacity - k * size, {})
                to[((size, k),)] = to.get(((size, k),), 0) + n
    return [(config, n) for held in rooms.values() for config, n in held.items()]


def plan(histogram: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: rows (length, first rank, pieces a sequence, first sequence,
    offset).  The size depends on the capacity and the rounds, not on the corpus."""
    full = histogram.pop(capacity, 0)
    configs: list[tuple[tuple[tuple[int, int], ...], int]] = [(((capacity, 1),), full)] if full else []
    if histogram:
        sizes = np.array(sorted(histogram))
        demand = np.array([histogram[s] for s in sizes.tolist()])
        left, made = demand.copy(), []
        for used, n in solve(sizes, demand, capacity):
            for k, each in used.items():
                left[k] -= n * each
            made.append((tuple((int(sizes[k]), each) for k, each in sorted(used.items(), reverse=True)), n))
        made += best_fit(sizes[left > 0], left[left > 0], capacity)
        # Where most pieces are long, a program that leaves no room may need more sequences than best fit alone.
        alone = best_fit(sizes, demand, capacity)
        configs += min(made, alone, key=lambda found: sum(n for _, n in found))
    rank: dict[int, int] = {}
    rows, first = [], 0
    for config, n in configs:
        offset = 0
        for size, each in config:
            rows.append((size, rank.get(size, 0), each, first, offset))
            rank[size] = rank.get(size, 0) + n * each
            offset += size * each
        first += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("size", "rank", "each", "first", "offset"), cols)) | {"sequences": first}


def pack(pieces: DataFrame, capacity: int = 2048, rows_a_group: int = 100_000) -> DataFrame:
    """Add sequence_id and offset to pieces that have a length of 1 to ``capacity``.

    ``pieces`` is read several times and should be a stored table.  Ranks within a length are counted
    in salted groups of about ``rows_a_group`` rows, so a length that a third of all rows share is
    spread out.  Equal rows are interchangeable.  An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    salts = max(1, -(-sum(histogram.values()) // rows_a_group))
    where = spark.sparkContext.broadcast(plan(histogram, capacity))

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(order) - 1).join(bases, ["length", "_salt"]).select(*pieces.columns, (F.col("_base") + F.col("_in")).alias("_rank"))

    names = list(pieces.columns)

    def place(batches):
        p = where.value
        key = p["size"] * 2**44 + p["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            k = np.searchsorted(key, length * 2**44 + rank, "right") - 1
            j, slot = np.divmod(rank - p["rank"][k], p["each"][k])
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p["first"][k] + j), pa.array(p["offset"][k] + slot * length)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, specials: bool = False) -> DataFrame:
    return pack(materialize(token_pieces(docs, vocabulary, capacity, specials=specials), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), specials=True)
