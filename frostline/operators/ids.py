"""Reproducible order by hash, and numbering of rows across partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frostline.sources.storage import stored


def hash_order(key: Column, seed: int | str) -> Column:
    """The first 32 bits of md5("seed:key"), an order that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def hash_uniform(key: Column, seed: int | str) -> Column:
    return hash_order(key, seed) / F.lit(4294967296.0)


def numbered(df: DataFrame, *order: str | Column, name: str = "rn") -> DataFrame:
    """Number rows from 1 in a total order, without a single task for all rows.

    Rows are range-partitioned and sorted, stored so that every read finds them alike, and numbered by
    their place in their partition plus the sizes of the partitions before it.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = stored(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1).drop("_part", "_at", "_before")


def running_total(df: DataFrame, value: str, *order: str, name: str = "before") -> DataFrame:
    """Add the sum of ``value`` over the rows before in a total order, range by range as in ``numbered``."""
    cols = [F.col(c) for c in order]
    placed = stored(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_n"))  # one row a range
    bases = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed.withColumn("_inside", inside).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_inside")).drop("_part", "_inside", "_base")


def dense_remap(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: 0..n-1 by ascending distinct value of ``column``."""
    ids = numbered(df.select(column).distinct(), column, name=name).withColumn(name, F.col(name) - 1)
    return df.join(ids, column)


def segments(rows: DataFrame, value: str, *by: str, size: int = 1_024, name: str = "items") -> DataFrame:
    """(by, segment, degree, name): each group's distinct values in order, ``size`` of them a row, segments from 0.

    Values are numbered over all groups at once, so neither a task nor a row holds a whole group.
    """
    placed = stored(numbered(rows.select(*by, value).distinct(), *by, value, name="_n"))
    first = placed.groupBy(*by).agg(F.min("_n").alias("_n0"), F.count("*").alias("degree"))
    cut = placed.join(first, list(by)).withColumn("segment", F.expr(f"(_n - _n0) div {size}"))
    return cut.groupBy(*by, "segment", "degree").agg(F.sort_array(F.collect_list(value)).alias(name)).select(*by, "segment", "degree", name)


class HashOrder:
    """Rows in the order of a hash below 2^32, then of ``ties``: how many there are, and conditions for the first n.

    A count of rows by the hash's upper half, and one by its lower half inside the halves that are asked for, tell
    the n-th row's hash, so nothing is sorted or numbered; either is at most 65,536 rows, however many there are.
    The rows are read a few times and should be stored.
    """

    def __init__(self, df: DataFrame, order: Column, *ties: str):
        self.df, self.order, self.ties = df, order, ties
        self.upper = dict(map(tuple, df.groupBy(F.shiftright(order, 16).alias("b")).agg(F.count("*")).collect()))
        self.n = sum(self.upper.values())

    @staticmethod
    def _holds(counts: dict[int, int], n: int) -> tuple[int, int]:
        """(key that holds the n-th row in order of keys, rows before that key)."""
        before = 0
        for key in sorted(counts):
            if before + counts[key] >= n:
                return key, before
            before += counts[key]
        raise ValueError(n)

    def first(self, *ns: int) -> list[Column]:
        """For each n a condition that the first n rows meet and no others."""
        inside = {n: self._holds(self.upper, n) for n in ns if 0 < n < self.n}
        lower: dict[int, dict[int, int]] = {}
        if inside:
            halves = sorted({b for b, _ in inside.values()})
            for x, c in self.df.select(self.order.alias("x")).where(F.shiftright("x", 16).isin(halves)).groupBy("x").agg(F.count("*")).collect():
                lower.setdefault(x >> 16, {})[x] = c
        out = []
        for n in ns:
            if n not in inside:
                out.append(F.lit(n > 0))
                continue
            half, before = inside[n]
            x, more = self._holds(lower[half], n - before)
            left = n - before - more
            if left == lower[half][x]:
                out.append(self.order <= x)
                continue
            # Some of the rows of one hash: the last of them by the ties.
            last = self.df.where(self.order == x).select(*self.ties).orderBy(*self.ties).limit(left).collect()[-1]
            tie = F.struct(*self.ties) <= F.struct(*[F.lit(last[t]).cast(self.df.schema[t].dataType).alias(t) for t in self.ties])
            out.append((self.order < x) | ((self.order == x) & tie))
        return out
