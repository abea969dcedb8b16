"""Verified passages against full alignments, and documents that stay."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from plumbrow.llm import decontaminate as D, queries

SETTINGS = D.Settings()


def fold(text):
    out = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text)
    while "  " in out:
        out = out.replace("  ", " ")
    return "".join(c.lower() if c < "Ā" else c for c in out).encode()


def least_cost(pattern, text):
    """Fewest edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def holds(item, text):
    """Whether some window of the item aligns within its budget."""
    body, text = fold(item), fold(text)
    index = D.Index([(0, item)], SETTINGS)
    return any(least_cost(body[a : a + m], text) <= e for _, a, m, e, _ in index.windows.tolist())


def prose(rng, words):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(words))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.choice("idr")
        if kind == "i":
            out.insert(at, "z")
        elif kind == "d":
            del out[at]
        else:
            out[at] = "y"
    return "".join(out)


@pytest.mark.parametrize("seed", range(8))
def test_same_as_full_alignment(seed):
    rng = random.Random(seed)
    item = prose(rng, rng.choice([9, 14, 30]))
    texts = [None, "", " ", prose(rng, 5), prose(rng, 60)]
    for n in (0, 1, 2, 3, 5, 6, 7, 9, 14, 25):
        texts.append(prose(rng, 3) + " " + edited(rng, item, n) + " " + prose(rng, 3))
        texts.append(edited(rng, item, n))
    texts += [item.upper(), item.replace(" ", " \n\t "), item[: len(item) // 2], item + item, item[1:] + "x"]
    index = D.Index([(7, item)], SETTINGS)
    found = {f[0] for f in index.search(pa.array(texts))}
    assert found == {n for n, t in enumerate(texts) if holds(item, t or "")}
    for n, t in enumerate(texts):  # the same in a buffer of its own
        assert bool(index.search(pa.array([t], pa.string()))) == (n in found)


def test_places_and_long_texts():
    rng = random.Random(20)
    items = [(i, prose(rng, 30)) for i in range(40)] + [(90, None or ""), (91, "short"), (92, items_text := prose(rng, 25)), (93, items_text)]
    index = D.Index(items, SETTINGS)
    text = "É " + prose(rng, 20000) + " " + items[3][1] + " " + prose(rng, 300) + " " + items[3][1].title() + " . " + items_text
    found = index.search(pa.array(["x", text]))
    assert sorted((f[0], f[1]) for f in found) == [(1, 3), (1, 3), (1, 92), (1, 93)]
    raw = text.encode()
    for _, item, a, b, edits in found:
        assert edits == 0 and fold(raw[a:b].decode()) == fold(dict(items)[item])


def test_queries_and_cleaning(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = queries.op4_decontaminate(spark, sf).collect()
    bodies = {r.item_id: fold(r.text) for r in items.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {(r.doc_id, r.item_id) for r in got}
    assert {(i, n) for i, t in texts.items() for n, b in bodies.items() if b in fold(t)} <= found
    for i, n in found:
        assert holds(next(r.text for r in items.collect() if r.item_id == n), texts[i])
    left = D.clean_documents(docs, items)
    assert left.schema == docs.schema
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(texts) - {i for i, _ in found})


def test_item_blocks_extra_columns_and_empty_tables(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, 20), 1) for i in range(6)] + [(9, None, 1)]
    rows = [(1, items[0][1], 5, "x"), (2, prose(rng, 40), 5, "x"), (3, f"a {items[5][1]} b", 5, "x"), (3, f"a {items[5][1]} b", 5, "x"), (None, items[2][1], 5, "x"), (4, None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    small = D.Settings(block_bytes=200)
    got = sorted(((r.doc_id or -1, r.item_id) for r in D.passages(docs, bench, small).collect()))
    assert got == [(-1, 2), (1, 0), (3, 5), (3, 5)]
    assert sorted(r.doc_id for r in D.clean_documents(docs, bench, small).collect()) == [2, 4]
    assert D.passages(docs.limit(0), bench).count() == 0 == D.passages(docs, bench.limit(0)).count()
    assert D.clean_documents(docs, bench.limit(0)).count() == 6


def test_partial_excerpts():
    """Any excerpt of window + stride - 1 bytes is found, with an edit as well; its neighbours are not."""
    rng = random.Random(22)
    item = "".join(rng.choices("abcdefgh ", k=236))
    index = D.Index([(4, item)], SETTINGS)
    length = SETTINGS.window + SETTINGS.stride - 1
    assert length < 64
    cuts = [item[a : a + length] for a in range(1, len(item) - length)]
    texts = [f"{prose(rng, 6)} {c} {prose(rng, 6)}" for c in cuts] + [edited(rng, f"{prose(rng, 3)} {c} {prose(rng, 3)}", 1) for c in cuts]
    assert {f[0] for f in index.search(pa.array(texts))} == set(range(len(texts)))
    assert index.search(pa.array([f"{prose(rng, 6)} {item[:110]} {prose(rng, 6)}"]))
    assert not index.search(pa.array([item[a : a + 30] for a in range(200)] + [prose(rng, 200) for _ in range(20)]))


def test_short_items_are_whole_words(spark):
    items = [(1, "To be  or not"), (2, "to be"), (3, "to be or not"), (4, " "), (5, ""), (6, "É a")]
    texts = ["x to BE\nor not y", "to beor not", "to be", "into be or", "e to be", "é A", None, "", "caf\u00e9 a", "to be to be"]
    found = D.Index(items, SETTINGS).search(pa.array(texts))
    want = [(n, i) for n, t in enumerate(texts) for i, words in items if words.strip() for k in range(len((t or "").split()))
            if fold(t).split()[k : k + len(words.split())] == fold(words).split()]
    assert sorted(f[:2] for f in found) == sorted(want) and {f[0] for f in found} == {0, 2, 4, 5, 9}
    assert all(fold(texts[r].encode()[a:b].decode()) == fold(dict(items)[i]) and e == 0 for r, i, a, b, e in found)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = D.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 6, 7, 8]


@pytest.mark.parametrize("size", [24_000, 96_000])
def test_repetitive_text_in_bounded_memory(size):
    """Every q-gram of the text meets every window of the item."""
    index = D.Index([(1, "ha " * 100)], D.Settings())
    tracemalloc.start()
    found = index.search(pa.array(["ha " * (size // 3)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20
    assert [f[:2] for f in found] == [(0, 1)] and found[0][3] - found[0][2] > 0.9 * size and found[0][4] == 0


def test_small_slices_give_the_same(spark, sf, monkeypatch):
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(-1, "ha " * 60), (-2, "so on and so on " * 9)]
    column = pa.array([*docs, "ha " * 500, None, "", "it went so on and so on " + "so on and so on " * 12])
    index = D.Index(items, D.Settings())
    whole = index.search(column)
    assert {f[1] for f in whole} >= {-1, -2} and len(whole) >= 5
    for postings, aligned in ((500, 1), (1013, 50)):
        monkeypatch.setattr(D, "POSTINGS", postings)
        monkeypatch.setattr(D, "ALIGNED", aligned)
        assert index.search(column) == whole
