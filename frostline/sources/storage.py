"""Shared storage for loops and consistent re-reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="frostline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(to)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage, the same rows at every read."""
    path = new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, when all that was made of it is stored elsewhere."""
    if path := getattr(df, "_stored_at", None):
        move_or_delete(df.sparkSession, path)


def move_or_delete(spark: SparkSession, path: str, to: str | None = None) -> None:
    """Rename a folder, or delete it; a target that is there already is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if to is None:
        fs.delete(place(path), True)
    elif fs.exists(place(to)) or not fs.rename(place(path), place(to)):
        raise FileExistsError(to)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file of a few lines, in place of one that is there."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(text.encode()))
    out.close()
