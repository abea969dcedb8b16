"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrow.llm import negatives, search
from plumbrow.llm.negatives import Settings


def brute(rows, k=5, low=80, asks=lambda i: i % 5 == 0):
    good = [
        (i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _, _ in good if asks(i)}):
        label, w = min((c, v) for i, c, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i, c) for i, c, v in good if i != q)
        positives = {(i, -s) for s, i in [(s, i) for s, i, c in scored if c == label][:k]}
        for p, top in positives:
            near = [(i, -s) for s, i, c in scored if c != label and low * top <= -100 * s <= 100 * top][:k]
            out += [(q, p, r, i, top, s) for r, (i, s) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, settings=Settings(), asks=lambda c: c % 5 == 0):
    df = spark.createDataFrame([(i, c, v, "x") for i, c, v in rows], "vec_id long, label int, embedding array<float>, score string")
    df = df.select("vec_id", "label", search.quantised(F.col("embedding")).alias("vector"), "score")
    return sorted(tuple(r) for r in negatives.mine(df, asks(F.col("vec_id")), settings).collect())


def clustered(rng, n, width=8, labels=3):
    """Rows near a few centres with labels that do not follow them, of several lengths."""
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [
        (i, rng.randrange(labels), [rng.choice([1, 1, 3]) * (x + rng.gauss(0, 0.2)) // 0.0625 * 0.0625 for x in rng.choice(centres)])
        for i in range(n)
    ]


@pytest.mark.parametrize("settings", [Settings(), Settings(tile=16, block=3, buckets=4), Settings(focus=1, tile=7, block=2)])
def test_against_all_products(spark, settings):
    rows = clustered(random.Random(5), 150)
    found = run(spark, rows, settings)
    assert len(found) > 100
    assert found == brute(rows)


def test_nulls_ties_repeated_rows_and_odd_vectors(spark):
    rng = random.Random(6)
    rows = clustered(rng, 40, width=4)
    rows += [(200, 1, None), (205, None, [1.0]), (None, 1, [1.0]), (210, 0, [None, 1.0]), (215, 1, [float("nan")]), (220, 2, [float("inf")])]
    rows += [(225, 0, []), (230, 1, [0.0] * 4), (235, 2, [1.0, -2.0]), (240, 0, [1.0] * 6)]
    rows += [(300 + i, i % 2, rows[3][2]) for i in range(12)]  # ties
    rows += [rows[10], rows[10], (10, 1, rows[4][2]), rows[11], rows[11]]  # repeated rows, and an anchor id with two vectors
    assert run(spark, rows, Settings(tile=11, block=2)) == brute(rows)


def test_one_vector_owns_the_table(spark):
    rng = random.Random(7)
    rows = clustered(rng, 60)
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(200)]
    assert run(spark, rows, Settings(tile=32, block=4, buckets=8)) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 0, [0.9])]) == [(0, 1, 1, 2, 65536, 58880)]
    assert run(spark, [(0, 1, [-1.0]), (1, 1, [1.0]), (2, 0, [0.9])]) == []  # no score is between 0.8 and 1 of a negative one


def test_feasible_rows_hold_every_match_and_leave_others_out():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    near = centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 24)) * 0.1
    vectors = np.floor(1024 * near / np.linalg.norm(near, axis=1)[:, None]).astype(np.int64)  # one length bucket
    tile = negatives.Tile(np.arange(2000), vectors, 4)
    for q in range(0, 2000, 100):
        anchor = vectors[q]
        scores = vectors @ anchor
        least = int(scores[q] * 0.9)
        feasible = tile._feasible(anchor, float(np.sqrt((anchor**2).sum())), least)
        assert set(np.flatnonzero(scores >= least)) <= set(feasible)
        assert len(feasible) < 1000
        rows, products = tile.reaching(anchor, least)
        assert list(rows) == list(np.flatnonzero(scores >= least)) and list(products) == list(scores[rows])


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [float(2**20 + i), float(2**19 - i)]) for i in range(0, 24)]
    assert run(spark, rows) == brute(rows)
