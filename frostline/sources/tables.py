"""Readers for the inputs: tables, CSV pairs, JSON lines strict and tolerant, separated files, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frostline.operators.ids import numbered

PAIRS = "user_id long, item_id long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exists(spark: SparkSession, path: str) -> bool:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(to)
    return found is not None and len(found) > 0


def read_pairs(spark: SparkSession, path: str, empty_ok: bool = False) -> DataFrame:
    """Distinct (user_id, item_id) of CSV files with a header ``user,item``; where there are none, no rows
    or an error.  A path may be a glob, which unites all files it names."""
    if not _exists(spark, path):
        if empty_ok:
            return spark.createDataFrame([], PAIRS)
        raise FileNotFoundError(path)
    rows = spark.read.option("header", True).schema("user long, item long").csv(path)
    return rows.select(F.col("user").alias("user_id"), F.col("item").alias("item_id")).distinct()


def first_bad_line(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, row_idx, value): the first line, by file name, that is neither blank nor JSON; no row where all are good.

    Lines count from 1 in their file, row_idx from 0 over all files.  Tasks read byte ranges of the files; a range
    gives its number of lines and the place of its first bad one, and running sums of the ranges' numbers say which
    line of its file that is, so no line is sorted or sent anywhere.  An object that repeats a key isn't JSON here.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    bad = (F.trim("value") != "") & F.try_parse_json("value").isNull()
    ranges = lines.groupBy("file", "_block").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"), F.min(F.when(bad, F.struct("_line", "value"))).alias("_bad"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a range of a file.
    placed = ranges.withColumn("_file", before(Window.partitionBy("file").orderBy("_block"))).withColumn("_all", before(Window.orderBy("file", "_block")))
    at = F.col("_bad._line") - F.col("_first")
    return placed.where("_bad is not null").select("file", (F.col("_file") + at + 1).alias("line"), (F.col("_all") + at).alias("row_idx"), F.col("_bad.value").alias("value")).orderBy("row_idx").limit(1)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines, of which a bad one is an error that names its file and line; blank lines are skipped."""
    if bad := first_bad_line(spark, path).first():
        raise ValueError(f"could not parse {bad.file}:{bad.line}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_separated(spark: SparkSession, path: str, names: list[str], sep: str = "::", encoding: str = "ISO-8859-1") -> DataFrame:
    """Files without a header whose fields are parted by several characters, all columns as strings."""
    return spark.read.option("sep", sep).option("encoding", encoding).schema(", ".join(f"`{n}` string" for n in names)).csv(path)


def read_latin1(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, row_idx): lines of text files numbered from 0 without gaps, by file name and place in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return numbered(lines, "_file", "_block", "_line", name="row_idx").select("value", (F.col("row_idx") - 1).alias("row_idx"))


def read_predictions(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(row_idx, valid, parsed): JSON lines in order; a bad line has null fields and isn't valid."""
    lines = read_lines(spark, path)
    valid = F.get_json_object("value", "$").isNotNull()
    return lines.select("row_idx", valid.alias("valid"), F.when(valid, F.from_json("value", schema)).alias("parsed"))


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables that share row_idx; tables of different length are an error."""
    if (a := left.count()) != (b := right.count()):
        raise ValueError(f"{a} rows beside {b}")
    return left.join(right, "row_idx")


def read_tree(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str, *names: str) -> DataFrame:
    """JSON files of a tree (a glob), with columns from the groups of a pattern over their paths."""
    rows = spark.read.schema(schema).json(path).withColumn("_path", F.input_file_name())
    for k, name in enumerate(names, 1):
        rows = rows.withColumn(name, F.regexp_extract("_path", pattern, k))
    return rows.drop("_path")


def with_all(rows: DataFrame, group: str, member: str, n: int) -> DataFrame:
    """Rows of the groups that have n different members."""
    full = rows.groupBy(group).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") == n).select(group)
    return rows.join(full, group, "left_semi")


def last_block(spark: SparkSession, path: str, mark: str, names: list[str]) -> DataFrame:
    """(file, metrics): of each log the last line that begins with a mark, its ``name=value`` pairs as doubles."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    last = lines.where(F.col("value").startswith(mark)).groupBy("file").agg(F.max_by("value", F.struct("_block", "_line")).alias("value"))
    metric = lambda name: F.regexp_extract("value", rf"(?:^|\s){name}=(-?[0-9.eE+-]+)", 1).try_cast("double").alias(name)
    return last.select("file", *[metric(n) for n in names])


def read_matrix(spark: SparkSession, path: str, rows_a_task: int = 65_536) -> DataFrame:
    """(id, v array<double>) of a two-dimensional ``.npy`` file; tasks read the rows' own bytes."""
    import numpy as np
    import pandas as pd
    from pyarrow import fs

    def opened():
        there, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        return there.open_input_file(name)

    with opened() as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        start = f.tell()
    if len(shape) != 2 or by_column:
        raise ValueError(f"{path}: not a matrix by rows")

    def read(parts):
        for pdf in parts:
            for a in pdf["a"].tolist():
                n = min(rows_a_task, shape[0] - a)
                with opened() as f:
                    raw = f.read_at(n * shape[1] * dtype.itemsize, start + a * shape[1] * dtype.itemsize)
                x = np.frombuffer(raw, dtype).reshape(n, shape[1]).astype(float)
                yield pd.DataFrame({"id": np.arange(a, a + n), "v": list(x)})

    starts = spark.range(0, shape[0], rows_a_task, numPartitions=max(1, -(-shape[0] // rows_a_task))).withColumnRenamed("id", "a")
    return starts.mapInPandas(read, "id long, v array<double>")


def checked_matrix(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(id, vector) tables whose vectors all have one length; others are an error."""
    sizes = vectors.agg(F.min(F.size(vec)).alias("a"), F.max(F.size(vec)).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError(f"vectors of {sizes['a']} to {sizes['b']} components")
    return vectors


def reviews_path(kind: str, category: str) -> str:
    """Where a category's raw reviews or metadata are, under a catalogue's root."""
    if kind not in ("review", "meta"):
        raise ValueError(kind)
    return f"raw/{kind}_categories/{category}.jsonl" if kind == "review" else f"raw/meta_categories/meta_{category}.jsonl"


def cold_side(spark: SparkSession, folder: str, flag: str | None = None) -> str:
    """``user`` or ``item``: which side of a folder of splits is cold.

    A flag decides; else ``cold_object`` in its split_meta.json; else which side's cold test it has.
    """
    if flag:
        found = flag
    elif _exists(spark, f"{folder}/split_meta.json"):
        found = spark.read.schema("cold_object string").option("multiLine", True).json(f"{folder}/split_meta.json").first()[0]
    else:
        sides = [s for s in ("item", "user") if _exists(spark, f"{folder}/cold_{s}_test*")]
        found = sides[0] if len(sides) == 1 else None
    if found not in ("user", "item"):
        raise ValueError(f"{folder}: neither a flag nor files tell the cold side")
    return found
