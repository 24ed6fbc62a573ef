"""Missing labels, clashing columns, special strings, early stopping, names without titles, sizes of samples."""

import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SCHEMA, text
from tokenizers import Tokenizer

from frostline.llm import common, exact_topk, mixing, packing, quality, surrogates, token_files, toxicity


@pytest.mark.parametrize("known", [[], [(1, 1, 0), (2, 1, 0), (3, 0, 0)], [(1, 1, 1), (2, 1, 1)]])
def test_nothing_is_dropped_without_labels_of_both_classes(spark, docs, known):
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    assert toxicity.without_toxic(docs, labels).count() == docs.count()
    assert {(r["predicted"], r["score"] < 0.5) for r in toxicity.toxicity_scores(docs, labels).collect()} == {(0, True)}
    if len({q for _, q, _ in known}) < 2:
        assert all(r["kept"] == (not r["base_failed"]) for r in quality.quality_rules(docs, labels).collect())


def test_pipeline_without_labels_or_documents(spark, tmp_path):
    import corpus_pipeline

    rows = [(k, text(700 + k, 60), "en", "ab"[k % 2], 5, k, 0.5, f"kept {k}") for k in range(12)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    d, stages = str(tmp_path), dict(corpus_pipeline.STAGES)
    hidden = stages["pii"](spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert sorted((r["doc_id"], r["entities"]) for r in hidden.collect()) == [(k, f"kept {k}") for k in range(12)]
    assert {r["doc_id"] for r in stages["mixing"](spark, hidden, d).collect()} <= set(range(12))
    assert corpus_pipeline.run(spark, d).count() > 0
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_special_strings_as_in_a_plain_call(spark, tmp_path):
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b", "<|endoftext|>", "  two  spaces <|endoftext|>\nline", "plain words only", None, ""]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, end, query in (("word_bpe_49k.json", 2, token_files.op6_token_files), ("byte_bpe_50k.json", 0, packing.op7_best_fit_packing)):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]
        got = {r["doc_id"]: r for r in query(spark, str(tmp_path)).collect()}
        assert [got[k]["ids_crc32"] for k in range(len(texts))] == [zlib.crc32(ids.tobytes()) for ids in want]


def test_lists_are_left_early_on_clustered_vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(10, 64)) * 3
    x = np.floor(100 * (centres[rng.integers(0, 10, 4096)] + 0.3 * rng.normal(size=(4096, 64))))
    ids = np.arange(4096)
    got, entries = exact_topk.block_topk(x[:30], ids[:30], x, ids, 10)
    assert entries < 0.5 * 30 * x.size
    for row in range(30):
        score = x @ x[row]
        score[row] = -np.inf
        best = np.lexsort((ids, -score))[:10]
        assert [(c, s) for r, c, s in got if r == row] == [(int(c), int(score[c])) for c in best]
    # What another block is known to reach lets lists be left sooner.
    least = np.array([min(s for r, _, s in got if r == row) for row in range(30)], float)
    assert exact_topk.block_topk(x[:30], ids[:30], x, ids, 10, least)[1] <= entries


def test_topk_over_many_groups(spark):
    """Many groups of candidates and blocks of queries, ties across blocks, and columns that play no part."""
    rng = np.random.default_rng(9)
    rows = [(k, [int(v) for v in rng.integers(-4, 5, 8)], "x", 1.0) for k in range(900)] + [(900 + k, [3] * 8, "y", 2.0) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, rank string, score double")
    got = sorted(map(tuple, exact_topk.exact_topk(df, df.where("vec_id % 50 = 0"), 5, block=64, query_block=9).collect()))
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    want = []
    for q in range(0, 1100, 50):
        score = (x @ x[q]).astype(float)
        score[q] = -np.inf
        want += [(q, n + 1, int(ids[c]), int(score[c])) for n, c in enumerate(np.lexsort((ids, -score))[:5])]
    assert got == want


def test_names_without_titles():
    t = "Yesterday Anna Schmidt called John Miller. Miller said that Anna-Maria and Annalena left; John-Paul Street, the Millers."
    found = [(k, t[a:b]) for a, b, k in surrogates.entities(t)]
    assert found == [("given:f:Latn", "Anna"), ("family:Latn", "Schmidt"), ("given:m:Latn", "John"), ("family:Latn", "Miller"), ("family:Latn", "Miller")]


def test_entities_take_time_in_proportion():
    def seconds(n):
        t = " ".join(f"Mr Name{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]} has {10**9 + k}" for k in range(n)) + "x" * 5 * n + "@"
        start = time.perf_counter()
        assert len(surrogates.entities(t)) > n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(8000) < 12 * seconds(1000) + 0.5


def test_surrogates_without_a_key_differ_by_session(spark):
    docs = spark.createDataFrame([(1, "Mr Brown has 1234567890", "kept")], "doc_id long, text string, entities string")
    one, two = (surrogates.with_surrogates(docs, column="found").first() for _ in range(2))
    assert one == two and one["entities"] == "kept" and [f["type"] for f in one["found"]] == ["family:Latn", "number"]
    assert surrogates.with_surrogates(docs, b"another", column="found").first()["text"] != one["text"]
    assert surrogates.with_surrogates(docs.limit(0)).count() == 0


def test_sample_by_hash(spark):
    rows = spark.range(100_000).withColumnRenamed("id", "doc_id")
    assert common.by_smallest_hash(rows, 100_000, 200_000).count() == 100_000
    assert 800 <= common.by_smallest_hash(rows, 100_000, 1000).count() <= 1000


def test_equal_rows_of_the_mix_are_taken_together(spark):
    rows = [(1, "one two three four", "a", "x")] * 5 + [(2, "five six", "a", "y"), (3, "seven eight nine", "b", "z"), (3, "seven eight nine", "b", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _h string")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["times"]
    held = [r["doc_id"] for r in out.collect()]
    assert {k: held.count(k) for k in (1, 2, 3)} == taken
