"""Flows against brute force, the laws of the new shards, and rewritten files."""

import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbrow.llm import queries, sharding


def brute_cost(supply, capacity, cost):
    """Least cost over all assignments of units."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    slots = [j for j, c in enumerate(capacity) for _ in range(c)]
    return min(sum(cost(i, j) for i, j in zip(units, p)) for p in itertools.permutations(slots, len(units)))


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_cheapest(seed):
    rng = random.Random(seed)
    supply = [rng.randint(0, 2) for _ in range(4)]
    capacity = [2, 1, sum(supply)][: rng.choice([2, 3])]
    if sum(capacity) < sum(supply):
        capacity.append(sum(supply))
    capacity = [min(c, 3) for c in capacity] + [max(0, sum(supply) - sum(min(c, 3) for c in capacity))]
    if sum(capacity) > 8:
        capacity = capacity[:-1]
    table = [[rng.randint(0, 5) for _ in capacity] for _ in supply]
    cost = lambda i, j: table[i][j]
    flow = sharding.cheapest_flow(supply, capacity, cost)
    for i, s in enumerate(supply):
        assert sum(v for (a, _), v in flow.items() if a == i) == s
    for j, c in enumerate(capacity):
        assert sum(v for (_, b), v in flow.items() if b == j) <= c
    assert sum(cost(*k) * v for k, v in flow.items()) == brute_cost(supply, capacity, cost)


def test_bytes_that_fit_stay():
    supply, capacity = [50, 10, 40, 20], [30, 30, 30, 30]
    flow = sharding.cheapest_flow(supply, capacity, lambda i, j: float(i != j))
    assert sum(v for (i, j), v in flow.items() if i != j) == 20 + 10
    with pytest.raises(ValueError):
        sharding.cheapest_flow([5], [4], lambda i, j: 0.0)


def check(rows, got, shards, slack):
    """rows: (doc_id, text)."""
    assert len(got) == len(rows)
    by, slots, bytes_ = {}, defaultdict(list), defaultdict(int)
    texts = dict(rows)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
        by.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(bytes_.values()) / shards
    assert all(abs(bytes_[j] - mean) <= slack for j in range(shards))
    return by


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op5_reshard(spark, sf).collect()
    mean = sum(len((t or "").encode()) + 1 for _, t in rows) / 8
    by = check(rows, got, 8, max(len((t or "").encode()) for _, t in rows) / 2 + 0.01 * mean)
    assert all(len(s) == 1 for s in by.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_few_bytes_move_and_hot_text_is_split(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("abé ", k=rng.randint(0, 60)))) for i in range(3000)]
    rows += [(5000 + i, "hot text " * 5) for i in range(1500)] + [(9000, None), (9001, ""), (9002, "long " * 100)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, size int")
    got = sharding.reshard(df, queries.text_shard(F.col("text"), 6), 8).collect()
    by = check(rows, got, 8, 400)
    assert [t for t, s in by.items() if len(s) > 1] == ["hot text " * 5]
    sizes = defaultdict(int)
    for r in got:
        sizes[r.old_shard] += r.size
    least = sum(max(0, s - sum(sizes.values()) / 8) for s in sizes.values())
    assert sum(r.size for r in got if r.shard != r.old_shard) <= least * 1.03 + 2000


def test_same_layout_moves_nothing_and_rewrite_skips_it(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i % 100:03d}") for i in range(400)], "doc_id long, text string")
    old = F.pmod("doc_id", F.lit(4))
    placed = sharding.reshard(df, old, 4).cache()
    assert placed.filter("old_shard <> shard").count() == 0 and sharding.changed_shards(placed, 4) == []
    one = sharding.reshard(df, F.when(F.col("doc_id") < 300, F.pmod("doc_id", F.lit(3))).otherwise(4), 4, [900, 900, 900, 900]).cache()
    assert sharding.rewrite(df, one, str(tmp_path / "out"), 4) == [3]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(300, 400))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(None, None)], "doc_id long, text string")
    got = sharding.reshard(df, F.lit(0), 2).collect()
    assert len(got) == 6 and len({(r.shard, r.slot) for r in got}) == 6
    assert sharding.reshard(df.limit(0), F.lit(0), 2).count() == 0


def test_files_of_a_layout_are_rewritten_in_place(spark, tmp_path):
    """Repeated rows stay as often as they were, untouched shards keep their files, shards that are gone leave none."""
    path = str(tmp_path / "layout")
    rows = [(i, f"text {i % 50:03d}", "x") for i in range(600)] * 2 + [(None, "null id", "y")] * 6 + [(7, None, "z")] * 2
    old = F.when(F.col("n") < 150, 0).when(F.col("n") < 300, 1).otherwise(2 + F.col("n") % 2)
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, other string, n int")
    df.withColumn("shard", old).write.partitionBy("shard").parquet(path)
    files = lambda k: sorted(p.name for p in (tmp_path / "layout" / f"shard={k}").glob("*.parquet"))
    before = files(0)
    here = spark.read.parquet(path)
    size = {r.shard: r.s for r in here.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("s")).collect()}
    got = sharding.reshard_files(here, F.col("shard"), 3, path, [size[0], size[1] + size[2], size[3] + 200]).collect()
    assert files(0) == before and not (tmp_path / "layout" / "shard=3").exists()
    back = spark.read.schema("doc_id long, text string, other string, n int, slot long, shard int").parquet(path).collect()
    assert sorted(r.n for r in back) == list(range(len(rows)))
    assert all((r.doc_id, r.text, r.other) == rows[r.n] for r in back)
    for k in range(3):
        placed = sorted((r.slot, r.doc_id or -1, r.size) for r in got if r.shard == k)
        assert [p[0] for p in placed] == list(range(len(placed)))
        mine = sorted((r.slot, r.doc_id or -1, len((r.text or "").encode()) + 1) for r in back if r.shard == k and k)
        assert not k or mine == placed


def test_rewrite_keeps_repeated_rows_and_other_shards(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, f"text {i % 40:03d}") for i in range(400)], "doc_id long, text string")
    path = str(tmp_path / "out")
    df.withColumn("shard", F.lit(0)).limit(5).write.partitionBy("shard").parquet(path)
    old = F.when(F.col("doc_id") < 30, F.pmod("doc_id", F.lit(3))).otherwise(4)
    placed = sharding.reshard(df, old, 4, [900, 900, 900, 900]).cache()
    assert sharding.rewrite(df, placed, path, 4) == [3]
    back = spark.read.parquet(path)
    assert back.filter("shard = 3").count() == 100 and back.filter("shard = 0").count() == 5


def test_query_writes_its_shards(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: str(tmp_path / name), raising=False)
    got = queries.op5_reshard(spark, sf).collect()
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.shard, r.slot, r.doc_id) for r in got) == sorted((r.shard, r.slot, r.doc_id) for r in back.collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
