"""Suffix arrays against sorted suffixes, and removed bytes against all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.brute import cut
from plumbrow.llm import queries, suffixes
from plumbrow.llm.suffixes import Settings


@pytest.mark.parametrize("seed", range(25))
def test_suffix_array(seed):
    rng = random.Random(seed)
    letters = rng.choice(["a", "ab", "abc", "abcdefgh\x00\xff"])
    raw = bytes(rng.choices(letters.encode("latin-1"), k=rng.randint(0, 300)))
    data = np.frombuffer(raw, np.uint8)
    order = suffixes.suffix_array(data, 10**6)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    got = suffixes.common_prefixes(data, order, 40)
    for a, b, n in zip(order[:-1], order[1:], got):
        same = 0
        while max(a, b) + same < len(raw) and raw[a + same] == raw[b + same] and same < 40:
            same += 1
        assert n == same


@pytest.mark.parametrize("seed", range(25))
def test_wanted_suffixes(seed):
    rng = random.Random(seed)
    raw = bytes(rng.choices(rng.choice([b"a", b"ab", b"abc"]), k=rng.randint(1, 300)))
    wanted = np.array([rng.random() < 0.3 for _ in raw])
    order = suffixes.suffix_array(np.frombuffer(raw, np.uint8), 10**6, wanted)
    assert [i for i in order.tolist() if wanted[i]] == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:])


@pytest.mark.parametrize("seed", range(25))
def test_every_string_has_one_owner(seed):
    rng = random.Random(seed)
    settings = Settings(length=30, gram=12)
    texts = [bytes(rng.choices(rng.choice([b"a", b"ab", b"abcdef"]), k=rng.choice([5, 29, 30, 31, 90, 200]))) for _ in range(6)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, place, h = suffixes.anchors(np.frombuffer(b"".join(texts), np.uint8), offsets, settings)
    first, last = suffixes.owned(place, h, row, offsets, settings)
    of = {}
    for a, b, p, v in zip(first.tolist(), last.tolist(), place.tolist(), h.tolist()):
        for s in range(a, b + 1):
            assert s not in of and s <= p <= s + 18
            of[s] = (p - s, v)
    whole = {o + i for o, t in zip(offsets.tolist(), texts) for i in range(len(t) - 29)}
    assert of.keys() == whole
    joined = b"".join(texts)
    by = {}
    for s, owner in of.items():
        assert by.setdefault(joined[s : s + 30], owner) == owner  # equal strings, equal places


def test_joined_ranges():
    got = suffixes._joined(*(np.array(c, t) for c, t in zip(zip(*[(1, 1, 5, 9), (1, 1, 0, 4), (1, 2, 4, 8), (1, 1, 8, 12), (1, 2, 1, 4)]), ("i8", "i8", "i4", "i4"))))
    assert list(zip(*(x.tolist() for x in got))) == [(1, 1, 0, 4), (1, 1, 5, 12), (1, 2, 1, 8)]


def check(rows, got, length):
    want = {i: w for (i, _), w in zip(rows, cut([t for _, t in rows], length))}
    assert len(got) == len(rows)
    for r in got:
        body, gone = want[r.doc_id]
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(body), sum(gone), spans), r.doc_id
        assert bytes(r.kept) == bytes(b for b, x in zip(body, gone) if not x)


def corpus(seed, n, scale=1):
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choices("abcdefg é", k=k))
    shared = [prose(rng.randint(20, 90) * scale) for _ in range(6)]
    texts = []
    for _ in range(n):
        text = prose(rng.randint(0, 120) * scale)
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(shared) + text[at:]
        texts.append(text)
    copy = list(texts[3] or "x" * 50)
    for _ in range(3):
        copy[rng.randrange(len(copy))] = "Z"
    texts += ["".join(copy), texts[5], texts[5], None, "", "q" * 400 * scale, "xy" * 150, prose(60) * 3, " "]
    return list(enumerate(texts))


@pytest.mark.parametrize("group, chunk", [(512, 150_000), (0, 150_000), (2, 40)])
def test_all_windows(spark, group, chunk):
    rows = corpus(3, 90)
    settings = Settings(length=40, gram=20, group=group, chunk=chunk, bucket=100, sorted_bytes=3000)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, k1 int, marks int").repartition(4)
    check(rows, suffixes.remove_repeats(df, settings).collect(), 40)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(rows, suffixes.remove_repeats(docs).collect(), 400)
    got = {r.doc_id: r.kept_sha256 for r in queries.op2_suffix_dedup(spark, sf).collect()}
    for (i, _), (body, gone) in zip(rows, cut([t for _, t in rows], 400)):
        assert got[i] == hashlib.sha256(bytes(b for b, x in zip(body, gone) if not x)).hexdigest()


def test_repeated_rows_null_ids_and_empty_table(spark):
    a, b = "".join(random.Random(1).choices("abcd", k=100)), "".join(random.Random(2).choices("abcd", k=100))
    df = spark.createDataFrame([(1, a), (1, a), (None, b), (None, None), (2, b[:39])], "doc_id long, text string")
    got = suffixes.remove_repeats(df, Settings(length=40, gram=20))
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in got.collect()) == [(0, 0, 0), (0, 100, 0), (1, 100, 100), (1, 100, 100), (2, 39, 0)]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
    assert suffixes.remove_repeats(df.filter(F.col("doc_id") == 2)).count() == 1


def test_equal_strings_have_equal_anchors():
    rng = random.Random(7)
    settings = Settings(length=30, gram=12)
    text = "".join(rng.choices("ab", k=200)).encode()
    data = np.frombuffer(b"zz" + text + b"qq" + text, np.uint8)
    row, place, h = suffixes.anchors(data, np.array([0, 202, 404]), settings)
    own = [set(zip((place[row == r] - s).tolist(), h[row == r].tolist())) for r, s in ((0, 2), (1, 204))]
    for k in range(len(text) - 30 + 1):
        inside = [{x for x in o if k <= x[0] <= k + 18} for o in own]
        assert inside[0] & inside[1]
