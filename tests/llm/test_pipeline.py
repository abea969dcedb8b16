"""Every stage of the pipeline against brute force on the rows it got."""

from collections import Counter

import pytest

import corpus_pipeline as pipeline
from llm.brute import linked
from plumbrow.llm import queries


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        result = stage(spark, docs, sf)
        if name != "sharding":
            assert result.schema.names == docs.schema.names
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_toxic_documents_go(spark, steps):
    scored = {r.doc_id: r.predicted for r in queries.op10_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert {r.doc_id for r in steps[1]} == {r.doc_id for r in steps[0] if not scored[r.doc_id]}
    assert set(steps[1]) <= set(steps[0])


def test_one_of_each_group_stays(steps):
    rows = steps[1]
    groups = linked([r.text for r in rows])
    want = {min(rows[m].doc_id for m in members) for _, members, _ in groups}
    assert Counter(steps[2]) == Counter(r for r in rows if r.doc_id in want)


def test_benchmark_passages_go(spark, steps):
    found = {r.doc_id for r in queries.op4_decontaminate(spark, "/root/testdata/sf0.01").collect()}
    assert Counter(steps[3]) == Counter(r for r in steps[2] if r.doc_id not in found)


def test_mix(steps):
    got, rows = Counter(steps[4]), steps[3]
    assert set(got) <= set(rows) and max(got.values()) <= 2
    size = lambda r: len(r.text.split())
    sources = sorted({r.source for r in rows})
    own = [sum(size(r) for r in rows if r.source == s) for s in sources]
    from plumbrow.llm.mixing import shared_out

    targets = shared_out(own, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5, 2)
    for s, target in zip(sources, targets):
        assert sum(n * size(r) for r, n in got.items() if r.source == s) == pytest.approx(target, rel=0.05, abs=300)


def test_shards(steps):
    rows, placed = steps[4], steps[5]
    assert Counter(r.doc_id for r in placed) == Counter(r.doc_id for r in rows)
    size = Counter()
    for r in placed:
        size[r.shard] += r.size
    assert len(size) == 8 and max(size.values()) < 1.02 * min(size.values())
    for s in size:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))


def test_run_is_all_stages(spark, steps):
    got = pipeline.run(spark, "/root/testdata/sf0.01").collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in steps[5])
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
