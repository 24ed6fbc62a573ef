import pytest

WORDS = "the of and river stone light under window paper morning garden silver people found nothing between letters across winter answer".split()


def text(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % len(WORDS)])
    return " ".join(out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, entities string"


@pytest.fixture(scope="session")
def rows():
    """Null, empty and very long texts, ties, repeated rows, null sources and ids, columns that clash."""
    base = text(1, 120).split()
    near = " ".join(base[:60] + ["changed"] + base[61:])
    docs = [
        (1, " ".join(base), "a"), (2, " ".join(base), "a"), (3, near, "b"), (4, None, "a"), (5, "", None), (6, " \n\t ", "b"), (7, "one two three", "c"), (7, "one two three", "c"),
        (8, text(2, 9000), "a"), (9, text(3, 300), None), (10, "ONE two THREE", "b"), (11, "x" * 30_000, "a"), (12, text(4, 80) + "\n" + text(4, 80), "b"),
        (13, "a\x1cb\x00c ‎d é 漢字 <|endoftext|>", "d"), *[(20 + k, text(50 + k, 40 + 30 * k), "abc"[k % 3]) for k in range(20)], (60, text(5, 2500), "c"),
    ]
    return [(i, t, "en", s, len(t) if t is not None else None, -1, 0.5, "x") for i, t, s in docs]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
