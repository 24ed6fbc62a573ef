"""Quality rules: document statistics, and gradient-boosted trees over them with monotone columns."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import trees
from frostline.llm.common import by_smallest_hash, fold, materialize, table

#: The symbols counted, and the white space that parts words.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper", "n_marks", "longest_word")
#: Columns that the trees see, and the direction in which quality may follow them.
FEATURES = {"n_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "line_words": 0, "distinct": 0, "digits": 0, "upper": 0, "marks": 0, "longest_word": 0}


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[:n].copy()
    for k in range(1, width):  # windows as numbers below the count of distinct windows so far
        key = key * len(number) + ids[k : n + k]
        if k + 1 < width and len(number) ** (k + 2) > 2**62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; a null text is empty and has zeros."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    dropped = len(raw) - len(raw.translate(None, SPACE))
    lines = [line for line in text.split("\n") if line.encode().split()]
    marks = len(raw.translate(None, bytes(range(128, 256)) + SPACE)) - len(raw.translate(None, NOT_LETTERS + bytes(range(128, 256))))
    return (
        len(words),
        len(text) - dropped,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        len(raw) - len(raw.translate(None, DIGITS)),
        len(raw) - len(raw.translate(None, UPPER)),
        marks,
        max(map(len, words), default=0),
    )


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every document."""

    def count(batches):
        for batch in batches:
            found = np.array([counts_of(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    made = {
        "n_words": c["n_words"], "word_length": c["word_chars"] / words, "symbols": c["n_symbols"] / chars, "dup_lines": c["n_dup_lines"] / lines,
        "repeats": c["n_repeat_words"] / words, "line_words": c["n_words"] / lines, "distinct": c["n_distinct"] / words, "digits": c["n_digits"] / chars,
        "upper": c["n_upper"] / chars, "marks": c["n_marks"] / chars, "longest_word": c["longest_word"],
    }
    return np.stack([made[f].astype(float) for f in FEATURES], 1)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_quality(counts: DataFrame, labels: DataFrame, most_rows: int = 40_000, **parameters) -> trees.Trees:
    """Fit the trees to labelled documents that pass the base rules and aren't held out.

    The fit takes at most ``most_rows`` rows, those with the smallest hashes of their ids; everything
    else about the operator covers all rows.  Held out are ids whose crc32 modulo 5 is 0.  Null labels
    and ids that label nothing are left out.  Where labels of either class are missing, every quality is 0.5.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_y"))
    rows = by_smallest_hash(counts, known.count(), most_rows).where(~base_failed()).where(fold() != 0).join(known, "doc_id")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(most_rows).select(*COUNTS, "_y").toPandas()
    x = features({c: sample[c].to_numpy() for c in COUNTS})
    y = sample["_y"].to_numpy(float)
    model = trees.fit(x, y, np.array(list(FEATURES.values())), **parameters)
    return model if 0 < y.sum() < len(y) else replace(model, start=0.0)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """COUNTS, base_failed, quality (0 to 1) and kept of every document.

    Null and empty texts have counts of zero and fail the base rules.  Repeated rows are each judged.
    Without labels of both classes all documents that pass the base rules have a quality of 0.5 and are kept.
    """
    spark = docs.sparkSession
    counts = materialize(document_counts(docs), "counts")
    model = spark.sparkContext.broadcast(fit_quality(counts, labels))

    def judge(batches):
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in COUNTS}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.score(features(c)), pa.float64())], [*batch.schema.names, "quality"])

    scored = counts.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", quality double")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
