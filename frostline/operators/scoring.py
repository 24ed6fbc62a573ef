"""Scores of prompts by a language model behind an interface, in chunks that a ledger remembers.

Examples are numbered once and stored; a chunk is a range of their numbers.  A task scores whole chunks and
puts each in place under its final name when it is complete, so the files that are there are the ledger:
after any failure only the absent chunks are scored.  A lock that is created atomically keeps a second run out.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.operators.ids import numbered
from frostline.sources.storage import new_path

MODES = ("next_token", "sequence", "generate")


class Scorer(Protocol):
    """A language model.  Tasks call it batch by batch; it is sent to them as it is, so it loads its weights when first called."""

    def next_token(self, prompts: list[str]) -> np.ndarray:
        """(n, 2): logits of the negative and of the positive label as the next token."""

    def sequence(self, prompts: list[str]) -> np.ndarray:
        """(n, 2): log-probabilities of both labels as continuations; -inf where a prompt leaves no room."""

    def generate(self, prompts: list[str]) -> list[str]:
        """What the model writes."""


class HashScorer:
    """A stand-in for a language model: the same numbers for the same prompt, by md5."""

    @staticmethod
    def _hash(tag: str, prompt: str) -> int:
        import hashlib

        return int(hashlib.md5(f"{tag}:{prompt}".encode()).hexdigest()[:8], 16)

    def next_token(self, prompts):
        return np.array([[(self._hash(f"t{k}", p) % 2001 - 1000) / 250 for k in (0, 1)] for p in prompts]).reshape(-1, 2)

    def sequence(self, prompts):
        return np.array([[-np.inf if self._hash(f"s{k}", p) % 17 == 0 else -(self._hash(f"s{k}", p) % 5000) / 1000 for k in (0, 1)] for p in prompts]).reshape(-1, 2)

    def generate(self, prompts):
        said = ("0.{0:02d}", "Probability: 0.{0:02d}.", "1", "I can't tell", "about 1.0")
        return [said[self._hash("g", p) % 5].format(self._hash("v", p) % 100) for p in prompts]


_NUMBER = re.compile(r"(?<![\d.])(?:0\.\d+|1\.0+)(?!\d)")


def probabilities(scorer: Scorer, mode: str, prompts: list[str], fallback: float = 0.0) -> tuple[list[float], list[str]]:
    """(probability of the positive label, what was generated) by prompt; what can't be read is ``fallback``, not a number is 0."""
    if mode == "generate":
        texts = scorer.generate(prompts)
        found = [_NUMBER.search(t) for t in texts]
        return [float(m[0]) if m else float(t.strip()) if t.strip() in ("0", "1") else fallback for m, t in zip(found, texts)], texts
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    x = np.asarray(getattr(scorer, mode)(prompts), float).reshape(-1, 2)
    with np.errstate(invalid="ignore", over="ignore"):
        p = 1 / (1 + np.exp(x[:, 0] - x[:, 1]))
    return np.nan_to_num(np.where(np.isneginf(x).all(axis=1), 0.0, p)).tolist(), [""] * len(prompts)


class Ledger:
    """A folder that all executors share: ``manifest``, numbered ``examples``, ``chunks`` and the lock."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        place = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: place(f"{self.folder}/{name}")
        self._fs = place(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def create(self, name: str, text: str) -> bool:
        """Create a file unless it is there; whether this call did.  The store decides between two calls."""
        self._fs.mkdirs(self._path("."))
        if self._fs.getScheme() == "file":  # its create looks first and writes then; the system's own call is one step
            if not self.spark._jvm.java.io.File(self._path(name).toUri().getPath()).createNewFile():
                return False
            out = self._fs.create(self._path(name), True)
        else:
            try:
                out = self._fs.create(self._path(name), False)
            except Exception as e:
                if self.exists(name):
                    return False
                raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        return "\n".join(self.spark.sparkContext.textFile(f"{self.folder}/{name}").collect())

    def lock(self, take_over: bool = False) -> str:
        owner = f"{self.spark.sparkContext.applicationId} {uuid.uuid4().hex}"
        if take_over and self.exists("lock"):
            self._fs.delete(self._path("lock"), False)
        if not self.create("lock", owner):
            raise RuntimeError(f"{self.folder} is locked by {self.read('lock')}; take_over=True breaks the lock of a run that is gone")
        return owner

    def unlock(self, owner: str) -> None:
        if self.exists("lock") and self.read("lock") == owner:
            self._fs.delete(self._path("lock"), False)

    def done(self) -> list[int]:
        """Numbers of the chunks that are complete."""
        if not self.exists("chunks"):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("chunks"))]
        return sorted(int(n[6:-8]) for n in names if n.startswith("chunk-") and n.endswith(".parquet"))


def _state(examples: DataFrame, order: list[str]) -> dict:
    found = examples.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*examples.columns).cast("decimal(38,0)")).alias("h")).first()
    return {"rows": found.n, "hash": str(found.h), "order": order}


def score_resumable(
    examples: DataFrame, prompt: Column, scorer: Scorer, folder: str, *order: str, mode: str = "next_token", chunk_rows: int = 10_000, batch_rows: int = 64, fallback: float = 0.0, most_chunks: int | None = None, take_over: bool = False
) -> DataFrame:
    """``examples`` with prompt, predict (six decimals as text) and generation, of all chunks that ``folder`` has now.

    A first call numbers the examples by ``order`` (all columns by default), stores them and scores them; a
    later one with the same examples and parameters scores only the chunks that are absent, as after a failure, and
    one with others is refused.  A chunk is ``chunk_rows`` examples in order; the scorer gets ``batch_rows`` prompts
    at a time.  ``most_chunks`` ends a run early, after so many.  While a run holds the folder's lock, others are
    refused; ``take_over`` breaks the lock of a run that didn't live to release it.
    """
    spark, order = examples.sparkSession, order or tuple(examples.columns)
    ledger = Ledger(spark, folder)
    owner = ledger.lock(take_over)
    try:
        ready = examples.withColumn("prompt", prompt)
        state = _state(ready, list(order)) | {"mode": mode, "chunk_rows": chunk_rows, "fallback": fallback}
        if not ledger.exists("manifest"):
            placed = numbered(ready, *order, name="_row").withColumn("_chunk", F.expr(f"(_row - 1) div {chunk_rows}"))
            placed.write.mode("overwrite").parquet(f"{ledger.folder}/examples")
            ledger.create("manifest", json.dumps(state))  # the examples are whole once this is there
        elif json.loads(ledger.read("manifest")) != state:
            raise ValueError(f"{folder} was begun with other examples or parameters: {ledger.read('manifest')}")
        stored = spark.read.parquet(f"{ledger.folder}/examples")
        ledger._fs.mkdirs(ledger._path("chunks"))
        done, n_chunks = ledger.done(), -(-state["rows"] // chunk_rows)
        absent = spark.range(n_chunks).withColumnRenamed("id", "_chunk").join(spark.createDataFrame([(c,) for c in done], "_chunk long"), "_chunk", "left_anti")
        left = n_chunks - len(done)
        if most_chunks is not None and most_chunks < left:
            absent, left = absent.orderBy("_chunk").limit(most_chunks), most_chunks
        if left:
            todo = stored.join(absent, "_chunk").repartition(min(left, 10_000), "_chunk").sortWithinPartitions("_chunk", "_row")
            _committed(todo, scorer, mode, f"{ledger.folder}/chunks", batch_rows, fallback).agg(F.sum("rows")).collect()
    finally:
        ledger.unlock(owner)
    out = stored.drop("_row", "_chunk").withColumn("predict", F.lit("")).withColumn("generation", F.lit(""))
    return spark.read.schema(out.schema).parquet(f"{ledger.folder}/chunks")


def _committed(todo: DataFrame, scorer: Scorer, mode: str, folder: str, batch_rows: int, fallback: float) -> DataFrame:
    """(chunk, rows) of the chunks that tasks have put in place; a chunk's rows come together and in order."""

    def scored(table: pa.Table) -> pa.Table:
        prompts, p, said = table.column("prompt").to_pylist(), [], []
        for i in range(0, len(prompts), batch_rows):
            a, b = probabilities(scorer, mode, [x or "" for x in prompts[i : i + batch_rows]], fallback)
            p, said = p + a, said + b
        return table.drop(["_chunk", "_row"]).append_column("predict", pa.array([f"{x:.6f}" for x in p], pa.string())).append_column("generation", pa.array(said, pa.string()))

    def put(chunk: int, table: pa.Table) -> pa.RecordBatch:
        import pyarrow.parquet as pq
        from pyarrow import fs

        there, path = fs.FileSystem.from_uri(folder)
        name, part = f"{path}/chunk-{chunk}.parquet", f"{path}/.{chunk}-{uuid.uuid4().hex}"
        pq.write_table(scored(table), part, filesystem=there)
        there.move(part, name)  # one step: a chunk is there whole or not at all; another try's is the same
        return pa.RecordBatch.from_pydict({"chunk": [chunk], "rows": [table.num_rows]}, pa.schema([("chunk", pa.int64()), ("rows", pa.int64())]))

    def run(batches):
        chunk, parts = None, []
        for batch in batches:
            numbers = batch.column("_chunk").to_numpy()
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                if a == b:
                    continue
                if numbers[a] != chunk and parts:
                    yield put(chunk, pa.Table.from_batches(parts))
                    parts = []
                chunk = int(numbers[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield put(chunk, pa.Table.from_batches(parts))

    return todo.mapInArrow(run, "chunk long, rows long")


def scored(examples: DataFrame, prompt: Column, scorer: Scorer, *order: str, **parameters) -> DataFrame:
    """``score_resumable`` in a folder of its own."""
    return score_resumable(examples, prompt, scorer, new_path(examples.sparkSession, "scores"), *order, **parameters)
