"""Top-k search against all inner products."""

import math
import random

from pyspark.sql import functions as F

from plumbrow.llm import search


def brute(rows, k, asks):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if asks(i)}):
        w = next(v for i, v in good if i == q)
        scores = sorted(((-sum(a * b for a, b in zip(w, v)), i) for i, v in good if i != q))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5, asks=lambda c: c % 5 == 0):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = search.search(df.select("vec_id", search.quantised(F.col("embedding")).alias("vector")), asks(F.col("vec_id")), k)
    return sorted(tuple(r) for r in got.collect())


def test_against_all_products(spark):
    rng = random.Random(5)
    rows = [(i, [round(rng.choice([0, 0, rng.gauss(0, 1)]) * 64) / 64 for _ in range(rng.choice([0, 3, 8, 8, 8]))]) for i in range(120)]
    rows += [(200, None), (205, [None, 1.0]), (210, [float("nan")]), (215, [float("inf"), 1.0]), (None, [1.0]), (220, [0.0] * 8), (225, [])]
    rows += [(300 + i, rows[7][1]) for i in range(9)]  # ties
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 5 == 0)
    assert run(spark, rows, k=1) == brute(rows, 1, lambda i: i % 5 == 0)


def test_blocks_and_chunks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) // 0.125 * 0.125 for _ in range(6)]) for i in range(90)]
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(search, "CHUNK", 7)
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 5 == 0)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
