"""The corpus pipeline: toxicity, near-duplicates, PII, source mix, packing; each stage reads what the last kept.

Null, empty and repeated rows go through every stage as the operators' docstrings say; columns of the
documents beside doc_id, text and source ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import mixing, near_dedup, packing, surrogates, toxicity
from frostline.llm.common import discard, free_name, materialize, named, table
from frostline.operators.ids import numbered


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted to be toxic, row by row."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of least doc_id; of equal rows one stays.

    Where a doc_id has several texts, each of them is a document of its own.  Rows without a doc_id can't be told
    apart by it and stay.
    """
    nameless = docs.where("doc_id is null")
    texts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    if texts.where("a <> b").isEmpty():
        out = _first_of_groups(docs)
    else:
        # Numbers of rows in the order of doc_id stand in for it, so that texts of one id are apart.
        row, of = free_name(docs.columns, "_row"), free_name([*docs.columns, "_row"], "_id")
        placed = numbered(docs.where("doc_id is not null").withColumn(of, F.xxhash64("text")), "doc_id", of, name=row).drop(of)
        keyed = placed.withColumnRenamed("doc_id", of).withColumnRenamed(row, "doc_id")
        out = _first_of_groups(keyed).drop("doc_id").withColumnRenamed(of, "doc_id").select(*named(*docs.columns))
    return out if nameless.isEmpty() else out.unionByName(nameless)


def _first_of_groups(docs: DataFrame) -> DataFrame:
    """The kept documents of a table whose rows of one doc_id are equal in text, once each; null ids are left out."""
    kept = materialize(near_dedup.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")), "kept")
    once, again = kept.where("_n = 1").select("doc_id"), kept.where("_n > 1").select("doc_id")
    out = docs.join(once, "doc_id", "left_semi")
    if not again.isEmpty():
        out = out.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.select(*named(*docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, detected entities replaced; ``n_chars`` is counted anew.  No column of the documents gives way."""
    found = surrogates.with_surrogates(docs, column=free_name(docs.columns, "entities")).select(*named(*docs.columns))
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a document comes as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), specials=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: learned scores, keyed permutations and a tokenizer are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
