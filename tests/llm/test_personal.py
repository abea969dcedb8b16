"""Personal data against plain regular expressions, and message passing against all labellings."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from plumbrow.llm import personal as P
from plumbrow.sources.views import table


def luhn(digits):
    doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    """(kind, start, end) by the patterns as they are stated."""
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    for kind, pattern, good in checks:
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if good(m[0])]
    return out


def rows(spark, texts, potentials=None, **settings):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    potentials = potentials or P.Potentials(np.zeros((P.Settings().features, 5)), np.zeros((5, 5)), np.zeros((5, 5)))
    got = P.find_personal(docs, potentials, ["doc_id"], settings=P.Settings(**settings)).orderBy("doc_id").collect()
    return [[[tuple(s) for s in r[c]] for c in ("base", "spans")] for r in got]


@pytest.fixture(scope="module")
def fitted(spark):
    return P.fit(table(spark, "/root/testdata/sf0.01", "documents"))


EDGES = [
    None, "", " ", "a@b.c", "a@b.c@d.e", "a@b@c.d", "a@b.c_d@e.f", "@", "@a.b", "a@.b", "ü@b.c ä.b@c-d.e-f.g", "a@b..c", "a@-.-",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3.999.1.2.3.4", "001.0002.3.255", "256.1.1.1", "1.2.3", "1..2.3.4", "9" * 50 + ".1.1.1",
    "4737097684299439", "4737 0976 8429 9439", "4737-0976-8429-9439 1", "4737  0976 8429 9439", "x4737097684299439y", "0" * 16, "0" * 20, "0 " * 19,
    "+1 (743) 555-3824", "+1", "+12", "+123", "+1234567 8", "++1 2345678", "+1 (743) 555-3824 +1 (743) 555-3824.", "+1((((", "日本 +49 30 1234567 日本 a@b.c",
]


def test_patterns_match_the_stated_ones(spark, sf):
    rng = random.Random(3)
    pool = ["1", "2", "9", "0", ".", "-", " ", "+", "@", "a", "Z", "_", "%", "(", ")", "ü", "\n", "4737097684299439", "12.34", "255", "a@b.c"]
    texts = EDGES + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    texts += [r["text"] for r in table(spark, sf, "documents").select("text").collect()]
    for text, (base, spans) in zip(texts, rows(spark, texts), strict=True):
        assert base == brute(text), text
        assert spans[: len(base)] == base


def all_labellings(unary, edges):
    """Marginals by the sum over every labelling."""
    n, k = unary.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        weight = sum(unary[i, y] for i, y in enumerate(labels)) + sum(t[labels[a], labels[b]] for pairs, t in edges for a, b in pairs)
        for i, y in enumerate(labels):
            out[i, y] += np.exp(weight)
    return out / out.sum(axis=1, keepdims=True)


def test_messages_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(4)
    unary, chain, skip = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=(3, 3))
    tree = [(np.array([[0, 1], [1, 2], [3, 4]]), chain), (np.array([[0, 5], [2, 4]]), skip)]
    assert np.allclose(P.marginals(unary, tree, 60, 0.25), all_labellings(unary, tree), atol=1e-6)
    loop = [(np.array([[0, 1], [1, 2], [2, 3], [4, 5]]), chain * 0.5), (np.array([[0, 3], [1, 5]]), skip * 0.5)]
    assert np.abs(P.marginals(unary, loop, 60, 0.25) - all_labellings(unary, loop)).max() < 0.05
    alone = P.marginals(unary, [(np.empty((0, 2), np.int64), chain)], 10, 0.25)
    assert np.allclose(alone, all_labellings(unary, []))


def test_fit_climbs_the_pseudo_likelihood():
    rng = np.random.default_rng(5)
    n, settings = 400, P.Settings(features=8, steps=400)
    facts = rng.integers(0, 8, (n, 2))
    group = rng.integers(0, 40, n)
    label = (group % P.LABELS).astype(np.int64)  # equal inside a group, and not told by any feature
    order = np.argsort(group, kind="stable")
    skip = np.array([sorted((a, b)) for a, b in zip(order[:-1], order[1:]) if group[a] == group[b]])
    found = P.fit_potentials(facts, label, np.empty((0, 2), np.int64), skip, settings)
    assert (np.diag(found.skip) > 1).all() and (found.skip - np.diag(np.diag(found.skip)) < 0.5).all()


def test_repeats_of_found_data_are_found_and_others_are_not(spark, fitted):
    filler = " ".join(["the quiet river went on and on"] * 30)
    texts = [
        f"write to hein.19@mail5.example.com {filler} or ask hein.19 today", f"write to nobody {filler} or ask hein.19 today",
        f"call +1 (743) 555-3824 {filler} or 743-555-3824 now", f"call nobody {filler} or 743-555-3824 now",
        f"card 4737097684299439 {filler} ref 4737/0976/8429/9439 end", f"card none {filler} ref 4737/0976/8429/9438 end",
        f"host 8.196.197.208 {filler} log 8-196-197-208 end", f"host none {filler} log 8-196-197-208 end",
    ]
    found = rows(spark, texts, fitted)
    for n in range(0, 8, 2):
        base, spans = found[n]
        assert len(base) == 1 and len(spans) == 2 and spans[1][0].startswith("near_")
        at = texts[n].index(re.search(r"hein\.19 today|743-555-3824|4737/\S+|8-196\S+", texts[n])[0])
        assert spans[1][1] == at
        assert found[n + 1] == [[], []]


def test_disguised_copies_of_held_out_texts(spark):
    """Copies of a text's own data are found, copies of other data are left alone."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    fitted = P.fit(docs.filter("doc_id % 2 = 0"))
    own = caught = others = wrong = 0
    settings = P.Settings()
    column = pa.array([r["text"] for r in docs.filter("doc_id % 2 = 1").collect()])
    bodies, truths = [], []
    for _, body, base, _ in P._scan(column):
        if base:
            changed, marks = P.disguise(body, base)
            bodies.append(changed)
            truths.append((len(base), marks))
    for (spans, everything), (n, marks) in zip(P._found(pa.array(bodies, pa.binary()), fitted, settings), truths, strict=True):
        added = everything[len(spans) :]
        hit = [any(a < d and c < b for _, a, b in added) for _, c, d in marks]
        own, caught = own + len(hit), caught + sum(hit)
        others, wrong = others + n - len(marks), wrong + sum(not any(a < d and c < b for _, c, d in marks) for _, a, b in added)
    assert own > 100 and others > 100
    assert caught / own > 0.95 and wrong / others < 0.05


def test_clean_texts_stay_clean(spark, fitted, sf):
    docs = [r["text"] for r in table(spark, sf, "documents").select("text").collect()]
    clean = [t for t in docs if not brute(t)]
    assert len(clean) > 50
    assert sum(1 for base, spans in rows(spark, clean, fitted) if spans) <= len(clean) // 200


@pytest.mark.parametrize("unit", ["1", "a", "@", "a@", "1.", "1 ", "(", "+1(", "a1", "(1", "+", "1-", "a@b.c "])
def test_long_texts_take_linear_time(fitted, unit):
    took = []
    for size in (250_000, 1_000_000):
        body = unit * (size // len(unit)) + "1"
        began = time.process_time()
        found = P._found(pa.array([body]), fitted, P.Settings())[0]
        took.append(time.process_time() - began)
        assert len(found[1]) >= len(found[0])
    assert took[1] < 8 * took[0] + 1


def test_same_rows_in_any_company(spark, fitted):
    text = "call +1 (743) 555-3824 or 743-555-3824, write a.b@c.de, a.b"
    alone = rows(spark, [text], fitted)[0]
    assert all(r == alone for r in rows(spark, [text] * 40, fitted)) and alone[1]
    together = rows(spark, EDGES + [text], fitted)
    assert together[-1] == alone


def test_empty_tables(spark):
    assert rows(spark, []) == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert (P.fit(docs).unary == 0).all()
    assert (P.fit(spark.createDataFrame([(1, None), (2, "plain words")], "doc_id long, text string")).skip == 0).all()
