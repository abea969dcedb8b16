"""Maximal segments against their definition, calibration, and held-out accuracy."""

import math
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbrow.llm import queries, text as T, toxicity


def brute_segments(scores, first=0):
    """The best segment, and the same left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[0]):
                best = (total, a, b)
    if best is None:
        return []
    total, a, b = best
    return [*brute_segments(scores[:a], first), (first + a, first + b, total), *brute_segments(scores[b + 1 :], first + b + 1)]


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments(seed):
    rng = random.Random(seed)
    scores = [rng.choice([rng.uniform(0.1, 4), -0.25, -0.25, rng.uniform(-3, -0.1)]) for _ in range(rng.randint(0, 60))]
    own = [(i, s) for i, s in enumerate(scores) if s != -0.25]
    got = toxicity.maximal_segments([i for i, _ in own], [s for _, s in own], -0.25)
    want = brute_segments(scores)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_rate_solves_the_equation():
    scores, counts = np.array([3.0, 1.0, -2.0]), np.array([5.0, 20.0, 100.0])
    rate = toxicity._rate(scores, counts, -0.25, 10_000)
    p = np.append(counts, 10_000 - counts.sum()) / 10_000
    assert np.sum(p * np.exp(rate * np.append(scores, -0.25))) == pytest.approx(1) and rate > 0


@pytest.fixture(scope="module")
def made(spark):
    """Texts of common words; toxic ones hold a passage with words of their own."""
    rng = random.Random(1)
    words, bad = [f"w{i}" for i in range(300)], [f"bad{i}" for i in range(8)]
    rows, marks = [], []
    for i in range(900):
        body = rng.choices(words, k=rng.randint(5, 200))
        toxic = int(rng.random() < 0.2)
        if toxic:
            at = rng.randrange(len(body))
            body[at:at] = [w for b in rng.choices(bad, k=4) for w in (b + "!", rng.choice(words))]
        rows.append((i, " ".join(body), 0.5))
        marks.append((i, toxic, 1.0))
    return rows, marks, spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(marks, "doc_id long, toxic int, score double")


def test_held_out_accuracy_and_passages(made):
    rows, marks, docs, labels = made
    model = toxicity.fit(docs, labels, train=F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in marks if i % 3 == 0]
    y = dict((i, t) for i, t, _ in marks)
    right = sum((got[i].score >= 0.3) == bool(y[i]) for i in held)
    assert right / len(held) > 0.97
    for i in held:
        words = rows[i][1].split()
        for p in got[i].passages:
            assert any("bad" in w for w in words[p["first"] : p["last"] + 1]) and words[p["first"]].startswith("bad")


def test_edge_rows(spark, made):
    _, _, docs, labels = made
    model = toxicity.fit(docs, labels)
    edge = [(1, None), (2, ""), (3, " \n"), (4, "bad1 bad2 bad3 " * 4000), (5, "w1 " * 30000), (5, "w1 " * 30000), (None, "bad1 bad2")]
    got = toxicity.score(spark.createDataFrame(edge, "doc_id long, text string"), model).collect()
    assert len(got) == len(edge) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3] <= by[5] < 0.3 <= by[4]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_one_class_no_labels_and_odd_labels(spark, made):
    _, _, docs, labels = made
    empty = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, empty).select("score").distinct().first()[0] == 0.5
    clean = toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)))
    assert toxicity.score(docs, clean).agg(F.max("score")).first()[0] < 0.01
    odd = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0.0), (3, None, 0.0)], labels.schema))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, odd)
    assert np.array_equal(a.tokens, b.tokens) and a.offset == b.offset


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [r for r in labels if got[r.doc_id].held_out]
    clean = [r for r in held if not r.toxic]
    assert sum(got[r.doc_id].predicted for r in clean) / len(clean) < 0.1
    assert sum(got[r.doc_id].score for r in held if r.toxic) / sum(r.toxic for r in held) > 3 * sum(got[r.doc_id].score for r in clean) / len(clean)


def test_score_uses_the_text_only(spark, made):
    rows, _, docs, labels = made
    model = toxicity.fit(docs, labels)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 5000)
    a = sorted(r.score for r in toxicity.score(docs, model).collect())
    assert a == sorted(r.score for r in toxicity.score(moved, model).collect())
    segments, counts = model.segments(pa.array([rows[0][1]]))
    assert len(segments) == 1 and counts[0] == len(rows[0][1].replace("!", "").split())


def test_scoring_takes_little_memory():
    """Memory of NumPy while 8 MB of text are scored in one batch; 76 MB before."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 700)]) for _ in range(2000)]
    batch = pa.record_batch([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])
    model = toxicity.Model(np.empty(0, np.uint64), np.empty(0), -0.25, 1.0, 1.0, 0.05, 0.0, 0.0)

    class Rows:  # what is handed to Spark, run here
        schema = None
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda m: SimpleNamespace(value=m)))

        def mapInArrow(self, run, schema):
            return run

    run = toxicity.without_toxic(Rows(), model, 0.6)
    T._powers.clear()
    tracemalloc.start()
    try:
        kept = sum(part.num_rows for part in run(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert kept == 2000 and most < 50 << 20
