"""The Jaccard join against all pairs."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from llm.brute import linked
from plumbrow.llm import jaccard, queries
from plumbrow.llm.jaccard import Settings


def check(rows, got):
    """rows: (doc_id, text) with distinct ids."""
    want = linked([t for _, t in rows])
    ids = [i for i, _ in rows]
    by = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got}
    assert len(got) == len(rows)
    for i, (n, members, links) in zip(ids, want):
        assert by[i] == (n, min(ids[m] for m in members), links), i


def corpus(seed, n):
    """Copies, near copies of several strengths, chains, a common passage, and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = rng.choices(words, k=12)
    texts = []
    for _ in range(n):
        base = rng.choices(words, k=rng.choice([3, 5, 6, 9, 30, 80]))
        if rng.random() < 0.4:
            base[rng.randrange(len(base)):0] = common
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(words)], [copy[at], "x"]])
            texts.append("\t ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    texts += [None, "", " \n ", "a", "A", "a b", "b a", "a b c d", "a b c d e", "a b c d e", "w " * 3000, "w " * 9, "é É"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 * i + 3, texts[i]) for i in order]


@pytest.mark.parametrize("settings", [Settings(), Settings(chunk=300, bucket=100, tile=4)])
def test_all_pairs(spark, settings):
    rows = corpus(2, 120)
    df = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, name binary, n int").repartition(5)
    check(rows, jaccard.jaccard_join(df, settings).collect())


def test_large_groups_in_small_tiles(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(base)) for i in range(40)]
    rows += [(2000 + i, " ".join(rng.choices(base, k=30)) + " the common line of many documents here") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, jaccard.jaccard_join(df, Settings(tile=16, bucket=500)).collect())


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.op6_jaccard(spark, sf).collect())


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, "other words"), (None, None), (7, "")], "doc_id long, text string")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in jaccard.jaccard_join(df).drop("text_hash").collect())
    assert got == [(-1, 0, -1, 0), (-1, 1, -1, 0), (-1, 2, 1, 3), (1, 2, 1, 3), (1, 2, 1, 3), (1, 2, 1, 3), (7, 0, 7, 0)]
    assert jaccard.jaccard_join(df.limit(0)).count() == 0
    kept = jaccard.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, [*df.distinct().filter("doc_id = 1 OR text <> 'a b c d e f' OR text IS NULL").collect()]))


def test_one_near_copy_stays_without_or_with_repeated_ids(spark):
    near = lambda k, word: " ".join([f"{word}{i}" for i in range(60)] + [f"end{k}"])
    rows = [(None, near(k, "a")) for k in range(4)] + [(5, near(k, "b")) for k in range(3)] + [(9, near(7, "b"))]
    rows += [(None, near(0, "c")), (8, near(1, "c")), (None, "a text of its own"), (None, ""), (None, "")]
    kept = jaccard.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for word, ids in (("a", [None]), ("b", [5]), ("c", [8])):
        assert [r.doc_id for r in kept if r.text.startswith(f"{word}0")] == ids
    assert sorted(r.text for r in kept if not r.text[1:2].isdigit()) == ["", "", "a text of its own"]


def test_bitmaps_bound_the_overlap():
    rng = random.Random(4)
    from plumbrow.llm import text as T

    for _ in range(200):
        a = [f"{rng.randrange(80)} {k}" for k in range(rng.randint(5, 40))]
        b = a[: rng.randint(4, len(a))] + [f"q{rng.randrange(50)}" for _ in range(rng.randint(0, 12))]
        keys, at = T.shingle_sets(pa.array([" ".join(a), " ".join(b)]), 5)
        x, y = sorted((keys[: at[1]], keys[at[1] :]), key=len)
        if not len(x):
            continue
        shared = len(set(x.tolist()) & set(y.tolist()))
        pair = [(len(s), jaccard.parity_bits(s, w := jaccard._bit_width(len(s))), w) for s in (x, y)]
        if 100 * shared >= 75 * (len(x) + len(y) - shared):
            assert jaccard._may_link(*pair, 75)
            assert abs(jaccard._band(len(x), 75) - jaccard._band(len(y), 75)) <= 1


def test_components_of_long_chains(spark):
    from plumbrow.llm.components import components

    rng = random.Random(3)
    names = [rng.randrange(10**9) for _ in range(120)]
    edges = list(zip(names[:80], names[1:80])) + [(names[90], names[95]), (names[95], names[95]), (names[100], names[95])]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    small = min(names[i] for i in (90, 95, 100))
    assert got == {**{n: min(names[:80]) for n in names[:80]}, **{names[i]: small for i in (90, 95, 100)}}


def test_packing_holds_a_chunk_once(monkeypatch):
    """Memory of NumPy while 16 MB of text are packed in chunks of 200,000 shingles; 79 MB before."""
    monkeypatch.setattr(jaccard, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 700)]) for _ in range(4000)]
    batch = pa.record_batch([pa.array([str(i) for i in range(4000)]), pa.array(texts)], ["doc_id", "text"])
    pack = jaccard._pack_sets(jaccard.Settings(chunk=200_000), 3)
    tracemalloc.start()
    try:
        seen = sum(part.num_rows for part in pack(iter([batch])) if part.column("bucket")[0].as_py() < 0)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == 4000 and most < 50 << 20
