"""Scores from the Bloom filter: exact base scores, counts through the quantiser, and both ways of probing."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbrow.llm import lm, queries, text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
EDGE = [None, "", " \t\n", "one", "One  ONE\x0bone", "É é x\x85y", "a" * 20000, "w " * 5000, "the cat sat", "the cat sat"]


def words(text):
    return [*WORD.findall((text or "").translate(FOLD)), None]


def exact(rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return {
        i: (len(words(t)), sum(counts[w] > 0 for w in words(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)))
        for i, t in rows
    }


def test_word_hashes_are_words():
    column = pa.array(EDGE)
    h, row = T.word_hashes(column)
    found = [(int(r), w) for r, t in enumerate(EDGE) for w in words(t)[:-1]]
    assert row.tolist() == [r for r, _ in found]
    by = {}
    for x, (_, w) in zip(h.tolist(), found):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_base_scores(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = exact(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    got = queries.op1_lm_scores(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3]) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(EDGE)] + [(None, "the cat sat", 0.1)], "doc_id long, text string, score double")
    got = lm.fit(docs, train=F.coalesce(F.col("doc_id"), F.lit(0)) < 9).score(docs, held_out=F.col("doc_id") == 9).collect()
    want = exact([(i, t) for i, t in enumerate(EDGE)] + [(None, "the cat sat")], lambda i: i is not None and i >= 9)
    assert len(got) == len(EDGE) + 1
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3])
    by = {r.doc_id: r.score for r in got}
    assert by[8] == by[9] == by[None] and by[0] == by[1] == by[2]


def test_no_rows_and_nothing_learnt(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.fit(docs.limit(0)).score(docs.limit(0)).count() == 0
    row = lm.fit(docs, train=F.lit(False)).score(docs).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("order", [2, 3])
def test_large_filter_gives_the_same_scores(spark, sf, order):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.col("doc_id") % 3 == 0
    fitted = lm.fit(docs, train=~held, settings=lm.Settings(order=order, bucket_tokens=20_000, block_bytes=200_000))
    near = {r.doc_id: r.score for r in fitted.score(docs).collect()}
    fitted.settings = lm.Settings(order=order, bucket_tokens=20_000, block_bytes=200_000, broadcast_bytes=0)
    far = {r.doc_id: r.score for r in fitted.score(docs).collect()}
    assert near.keys() == far.keys() and all(near[k] == pytest.approx(far[k]) for k in near)


def test_filter_returns_quantised_counts():
    settings = lm.Settings()
    rng = np.random.default_rng(1)
    prints = rng.choice(2**32, 5000, replace=False).astype(np.uint32)
    prints.sort()
    counts = rng.zipf(1.6, 5000).clip(1, 10**6)
    import pandas as pd

    built = lm._build(settings)((3,), pd.DataFrame({"bucket": [3], "prints": [T.planes(prints)], "counts": [T.planes(counts.astype(np.uint32))]}))
    f = lm.Filter.of(built.itertuples(index=False), 5, settings.probes, len(built["bits"][0]))
    got = f.levels(np.full(5000, 3), prints)
    want = lm._levels(counts, settings.base)
    assert (got >= want).all() and (got == want).mean() > 0.98
    absent = np.setdiff1d(rng.choice(2**32, 5000).astype(np.uint32), prints)
    assert (f.levels(np.full(len(absent), 3), absent) > 0).mean() < 0.02
    assert (f.levels(np.full(10, 1), absent[:10]) == 0).all()
    assert lm._level_values(settings.base)[1] == 1


def test_tokens_end_every_row_and_grams_start_anew():
    h, row = lm.tokens(pa.array(["a b", None, "a"]))
    assert row.tolist() == [0, 0, 0, 1, 2, 2] and h[2] == h[3] == lm.END
    uni, bi = lm.grams(h, row, 2)
    assert uni[2] == uni[3] and uni[0] == uni[4]
    assert bi[0] == bi[4] and len(set(bi.tolist())) == 5
    assert lm._marks(2)[0] not in set(bi.tolist()) | set(uni.tolist())


def test_every_ngram_of_a_piece_is_probed_once_and_by_bucket():
    key = np.random.default_rng(3).integers(0, 2**63, 400).astype(np.uint64)
    asked = []

    def lookup(bucket, prints):
        asked.append((bucket, prints))
        return (prints % np.uint32(7)).astype(np.int64)

    got = lm._looked_up(np.concatenate([key, key[::-1], key[:50]]), lookup, 5)
    assert (got == np.concatenate([key, key[::-1], key[:50]]).astype(np.uint32) % 7).all()
    (bucket, prints), = asked
    assert len(prints) == 400 and (np.diff(bucket) >= 0).all() and (bucket == lm._split(np.sort(key), 5)[0][0]).any()
    assert len(lm._looked_up(key[:0], lookup, 5)) == 0
