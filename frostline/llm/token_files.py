"""Token files: flat unsigned integers per shard, 64-bit document offsets, memory-mapped reading.

A shard is three files: ``.bin`` holds the ids of its documents one after another (16 bits each where
the vocabulary allows, else 32), ``.idx`` the n + 1 offsets of its documents in ids as unsigned 64-bit
integers, ``.doc`` their doc_id as signed 64-bit integers.  All are little-endian.  A table of the
shards (the manifest) names the files of the tasks that succeeded; its running sum of ids gives each
shard's base.  Documents with a null doc_id come first and are counted in the manifest.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frostline.llm.common import materialize, new_folder
from frostline.llm.encoding import encoder, slices, vocabulary_size

MANIFEST = "name string, first long, nulls long, n_docs long, n_tokens long"


def _create(folder: str, name: str):
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(folder)
    return there.open_output_stream(f"{path}/{name}")


def _map(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file's values: mapped into memory where it is local, else read."""
    from pyarrow import fs

    there, path = fs.FileSystem.from_uri(folder)
    if there.get_file_info(f"{path}/{name}").size == 0:
        return np.zeros(0, dtype)
    if isinstance(there, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype=dtype, mode="r")
    return np.frombuffer(there.open_input_file(f"{path}/{name}").read(), dtype)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, drops_space: bool = True, specials: bool = False) -> DataFrame:
    """Encode every text, append ``end_id``, write shards in ascending doc_id order; the manifest.

    Null and empty texts become the end id alone.  Rows that share a doc_id are all kept, ordered by
    text.  An empty table gives an empty manifest.  Other columns are ignored.  With ``specials``, strings
    of special tokens in a text become those tokens.
    """
    dtype = "<u2" if max(vocabulary_size(vocabulary) - 1, end_id) < 2**16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        enc, name = encoder(vocabulary, drops_space, specials), uuid.uuid4().hex
        data, lengths, ids, nulls = None, [], [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if texts and data is None:
                data = _create(folder, f"{name}.bin")
            nulls += batch.column("doc_id").null_count
            ids.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for a, b in slices(texts):
                for raw in enc.encode(texts[a:b]):
                    raw += end
                    lengths.append(len(raw) // 4)
                    data.write(np.frombuffer(raw, "<u4").astype(dtype).tobytes())
        if data is None:
            return
        data.close()
        with _create(folder, f"{name}.idx") as f:
            f.write(np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes())
        every = np.concatenate(ids)
        with _create(folder, f"{name}.doc") as f:
            f.write(every.tobytes())
        first = int(every[nulls]) if nulls < len(every) else None
        yield pa.RecordBatch.from_pylist([{"name": name, "first": None if nulls else first, "nulls": nulls, "n_docs": len(lengths), "n_tokens": int(sum(lengths))}], schema=pa.schema([("name", pa.string()), ("first", pa.int64()), ("nulls", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(write, MANIFEST), "manifest").withColumn("dtype", F.lit(dtype))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # One row for each shard: the window's one task holds a few numbers a shard, never documents.
    before = F.sum("n_tokens").over(Window.orderBy(F.col("first").asc_nulls_first(), "name").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.withColumn("base", F.coalesce(before, F.lit(0)))

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                idx, doc = _map(folder, f"{r['name']}.idx", "<u8"), _map(folder, f"{r['name']}.doc", "<i8")
                ids = _map(folder, f"{r['name']}.bin", r["dtype"])
                for a in range(0, r["n_docs"], 20_000):
                    b = min(r["n_docs"], a + 20_000)
                    at = np.asarray(idx[a : b + 1]).astype(np.int64)
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(at[:-1], at[1:])]
                    known = pa.array(np.asarray(doc[a:b]), pa.int64(), mask=np.arange(a, b) < r["nulls"])
                    yield pa.RecordBatch.from_arrays([known, pa.array(at[:-1] + r["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return based.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, vocabulary: str, **parameters) -> DataFrame:
    """Write the token files of a table and digest what is read back from them."""
    folder = new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, vocabulary, folder, **parameters), folder)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), specials=True)
