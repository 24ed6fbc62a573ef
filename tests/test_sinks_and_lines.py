"""Matrices by blocks with commit and abort, numbers of bad lines, nested values as text, scans of blends."""

import json
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.functions import text
from frostline.operators import evaluate
from frostline.sources import matrix_sink, sinks, tables


def matrix(spark, n=1_000, d=6, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([((i * 7) % n, x[(i * 7) % n].tolist()) for i in range(n)], "id long, v array<double>").repartition(5)


def files(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".npy"))


def test_blocks_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    x, frame = matrix(spark)
    matrix_sink.write_matrix(frame, path, 90)
    got = {r.id: r.v for r in matrix_sink.read_matrix_blocks(spark, path).collect()}
    assert len(got) == 1_000 and all(got[i] == x[i].tolist() for i in range(1_000))
    blocks = matrix_sink.manifest(path)["blocks"]
    assert sum(b[1] for b in blocks) == 1_000 and max(b[1] for b in blocks) <= 90 and [b[2] for b in blocks] == sorted(b[2] for b in blocks)
    assert files(path) == sorted(f"{b[0]}{s}" for b in blocks for s in (".npy", ".ids.npy"))
    # A block by itself is a plain matrix, which the reader of matrices reads too.
    one = tables.read_matrix(spark, f"file://{path}/{blocks[0][0]}.npy", 50)
    ids = np.load(f"{path}/{blocks[0][0]}.ids.npy")
    assert {r.id: r.v for r in one.collect()} == {k: x[i].tolist() for k, i in enumerate(ids)}


def test_a_second_write_is_refused_or_overwrites(spark, tmp_path):
    path = str(tmp_path / "m")
    x, frame = matrix(spark, 100)
    matrix_sink.write_matrix(frame, path)
    before = files(path)
    with pytest.raises(Exception, match="has a matrix already"):
        matrix_sink.write_matrix(frame, path)
    assert files(path) == before
    y, other = matrix(spark, 60, 3, 2)
    matrix_sink.write_matrix(other, path, overwrite=True, dtype="<f4")
    got = {r.id: r.v for r in matrix_sink.read_matrix_blocks(spark, path).collect()}
    assert len(got) == 60 and np.allclose([got[i] for i in range(60)], y, atol=1e-6) and not set(before) & set(files(path))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    _, frame = matrix(spark)
    broken = frame.withColumn("v", F.when(F.col("id") == 700, F.array(F.lit(1.0))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="vectors of one length"):
        matrix_sink.write_matrix(broken, path, 50)
    assert not os.path.exists(f"{path}/manifest.json")
    with pytest.raises(FileNotFoundError):
        matrix_sink.read_matrix_blocks(spark, path)
    matrix_sink.write_matrix(frame, path, 50)  # what tries left behind goes with the first commit
    blocks = matrix_sink.manifest(path)["blocks"]
    assert files(path) == sorted(f"{b[0]}{s}" for b in blocks for s in (".npy", ".ids.npy")) and matrix_sink.read_matrix_blocks(spark, path).count() == 1_000


def test_empty_matrix_and_columns(spark, tmp_path):
    _, frame = matrix(spark, 10)
    matrix_sink.write_matrix(frame.limit(0), str(tmp_path / "e"))
    assert matrix_sink.read_matrix_blocks(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(Exception, match="columns id and v"):
        frame.withColumnRenamed("v", "x").write.format(matrix_sink.FORMAT).option("path", str(tmp_path / "x")).mode("append").save()


def test_bad_lines_are_named(spark, tmp_path):
    """Files of several byte ranges; blank lines count and aren't bad; the first bad line by file and place is told."""
    good = [json.dumps({"a": k, "b": "x" * (k % 40)}) for k in range(3_000)]
    for name, bad in (("a.json", None), ("b.json", 2_111), ("c.json", 5)):
        lines = [g if k % 50 else "  " for k, g in enumerate(good)]
        if bad is not None:
            lines[bad], lines[bad + 300] = '{"a": 1', "also bad"
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = tables.first_bad_line(spark, str(tmp_path)).collect()
        assert [(r.file.split("/")[-1], r.line, r.row_idx, r.value) for r in got] == [("b.json", 2_112, 5_111, '{"a": 1')]
        with pytest.raises(ValueError, match=r"could not parse .*b\.json:2112$"):
            tables.read_json_lines(spark, str(tmp_path), "a long, b string")
        assert tables.first_bad_line(spark, str(tmp_path / "a.json")).count() == 0
        assert tables.read_json_lines(spark, str(tmp_path / "a.json"), "a long, b string").where("a is not null").count() == 2_940
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain(value, most=8, left=4):
    if value is None:
        return ""
    if isinstance(value, dict):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False) if not left else "; ".join(f"{k}: {plain(v, 4, left - 1)}" for k, v in list(value.items())[:most])
    if isinstance(value, list):
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False) if not left else "; ".join(plain(v, 4, left - 1) for v in value[:most])
    return str(value)


def test_nested_text(spark):
    rng = random.Random(2)

    def made(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind == 5:
            return {f"{rng.choice('zyxab')}{i}": made(depth - 1) for i in range(rng.randrange(10))}
        if kind == 6:
            return [made(depth - 1) for _ in range(rng.randrange(10))]
        return [None, rng.randrange(-50, 10**12), round(rng.random() * 100, 2), rng.choice(["", "text; x: y", '{"k": 1}', "[1]", 'é "q"', "true", "null"]), rng.random() < 0.5][kind]

    values = [made(5) for _ in range(300)] + [{}, [], "s", 1.50, 100.0, True, None]
    frame = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(values)] + [(-1, None), (-2, "{bad"), (-3, "")], "k long, x string")
    got = {r.k: r.t for r in frame.select("k", text.nested_text(F.col("x")).alias("t")).collect()}
    for k, v in enumerate(values):
        assert got[k] == plain(v), (k, v)
    assert got[-1] == got[-2] == got[-3] == ""


def test_blend_scan_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(u, i, "ab"[i % 2], round(rng.random(), 2), round(rng.random(), 2), int(rng.random() < 0.3)) for u in range(20) for i in range(40)]
    frame = spark.createDataFrame(rows, "user_id long, item_id long, entity_type string, a double, b double, label int")
    weights = [0.0, 0.3, 1.0]
    got = {(r.entity_type, r.weight): (r.hits, r.truth) for r in evaluate.blend_scan(frame, weights, 3, 40).collect()}
    lists = defaultdict(list)
    for u, i, t, a, b, y in rows:
        lists[t, u].append((i, a, b, y))
    want = {}
    for t in "ab":
        for w in weights:
            hits = sum(x[3] for (g, _), v in lists.items() if g == t for x in sorted(v, key=lambda x: (-round(w * x[1] + (1 - w) * x[2], 9), x[0]))[:3])
            want[t, w] = (hits, sum(r[5] for r in rows if r[2] == t))
    assert got == want
    limits = {"a": 0.2, "b": 0.25, "overall": 0.2}
    choices = evaluate.blend_choices(evaluate.blend_scan(frame, weights, 3, 40), limits).collect()
    recall = lambda t, w: want[t, w][0] / want[t, w][1]
    told = {(v, w): {"a": recall("a", v), "b": recall("b", w), "overall": (want["a", v][0] + want["b", w][0]) / (want["a", v][1] + want["b", w][1])} for v in weights for w in weights}
    best = max(told, key=lambda c: (round(min(told[c][g] - x for g, x in limits.items()), 8), round(sum(told[c].values()), 8), -c[0], -c[1]))
    assert len(choices) == 9 and [(r.a_weight, r.b_weight) for r in choices if r.chosen] == [best]
    assert all(r[g] == pytest.approx(told[r.a_weight, r.b_weight][g]) for r in choices for g in limits)


def test_exclude_coordinates(spark):
    positives = spark.createDataFrame([(1, 1), (1, 2), (3, 1), (3, 5), (9, 9), (3, 5)], "user_id long, item_id long")
    truth = spark.createDataFrame([(3, 1), (1, 2), (7, 7)], "user_id long, item_id long")
    assert sorted(map(tuple, sinks.exclude_coordinates(positives, truth).collect())) == [(0, 1), (1, 5)]


def test_nested_text_parses_a_level_once(spark):
    """Four parses a level (an object's texts and kinds, a list's), of which each has two kinds of parts: 60 for four levels."""
    frame = spark.createDataFrame([("{}",)], "x string").select(text.nested_text(F.col("x")).alias("t"))
    assert frame._jdf.queryExecution().analyzed().toString().count("from_json") <= 60


def test_a_matrix_of_so_many_digits_takes_four_bytes_a_cell(spark, tmp_path):
    x, frame = matrix(spark, 100)
    path, plain = str(tmp_path / "d"), str(tmp_path / "p")
    matrix_sink.write_matrix(frame, plain)
    matrix_sink.write_matrix(frame, path, digits=6)
    size = lambda p: sum(os.path.getsize(f"{p}/{f}") - 128 for f in files(p) if not f.endswith(".ids.npy"))
    assert size(path) * 2 == size(plain) == x.size * 8
    want = {r.id: r.v for r in frame.select("id", F.transform("v", lambda a: F.round(a, 6)).alias("v")).collect()}
    assert {r.id: r.v for r in matrix_sink.read_matrix_blocks(spark, path).collect()} == want


def test_digits_round_as_spark_does_and_spare_what_four_bytes_do_not_hold(spark, tmp_path):
    halves = spark.createDataFrame([(1, [0.0000005, -0.0000015, 1.0000025, -7.5e-7, 0.1234565, 2147.4836464])], "id long, v array<double>")
    large = spark.createDataFrame([(2, [2147.4836475, 1e12, float("nan"), 0.25, -1e300, 3.0])], "id long, v array<double>")
    for name, frame in (("halves", halves), ("large", large), ("both", halves.union(large).coalesce(1))):
        path = str(tmp_path / name)
        matrix_sink.write_matrix(frame, path, digits=6)
        rounded = lambda df: {r.id: str(r.v) for r in df.select("id", F.transform("v", lambda a: F.round(a, 6)).alias("v")).collect()}
        assert rounded(matrix_sink.read_matrix_blocks(spark, path)) == rounded(frame)
