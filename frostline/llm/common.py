"""Helpers shared by the corpus operators: shared storage, tables and word patterns."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than space and U+0009..U+000D.
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text after lower-casing A-Z only; a null text has none.

    The methods of bytes know ASCII alone: they lower A-Z and split at space and U+0009..U+000D.
    """
    return text.encode().lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and the session is local, a temporary folder is set; elsewhere its
    absence is an error, because a machine's own folder is not visible to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="frostline-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/frostline/{name}-{uuid.uuid4().hex}"
    jvm, sc = spark._jvm, spark.sparkContext
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(to)
    fs.deleteOnExit(to)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor
    costs nothing but a read."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, when all that was made of it is stored elsewhere."""
    if path := getattr(df, "_stored_at", None):
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def named(*columns: str) -> list:
    """Columns by their names as they are, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_name(taken: list[str], name: str) -> str:
    """A name that no other column has, by Spark's comparison, which knows no case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


@contextmanager
def same_splits(spark: SparkSession):
    """While this holds, files are cut for tasks alike, whatever executors come or go.

    Spark's split size follows the number of cores that there are at the moment; the number that there are now
    stays in force.
    """
    setting = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, before or str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id", n: int = 5):
    """crc32 of the id as text, modulo n; a null id counts as the text of nothing."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def by_smallest_hash(rows: DataFrame, n: int, most: int, doc_id: str = "doc_id") -> DataFrame:
    """Of about n rows, those in the share of all id hashes that holds 0.95 * most of them.

    The share is the same in every task, so that few rows more than the sample leave their tasks.
    """
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(doc_id), F.lit(2**32)) < F.lit(int(2**32 * 0.95 * most / n)))


def one_thread() -> None:
    """A task has one core: libraries start no threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


_KEPT: dict = {}


def kept(owner: str, key=None, make=None):
    """What a worker process keeps from task to task; it keeps things of one operator at a time.

    When another operator's task asks, what is there goes and its memory is given back, so that the stages of a
    pipeline, which share worker processes, don't add up.  Without ``make`` that is all that is done.
    """
    if _KEPT.get("owner") != owner:
        had = len(_KEPT) > 1
        _KEPT.clear()
        _KEPT["owner"] = owner
        if had:
            gc.collect()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)
    if make is None:
        return None
    if ("made", key) not in _KEPT:
        _KEPT.clear()
        _KEPT.update({"owner": owner, ("made", key): make()})
    return _KEPT["made", key]
