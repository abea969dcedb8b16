"""Plan shapes that must hold at scale."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from plumbrow.operators import audit, sampling
from plumbrow.plans import catalog
from plumbrow.plans.catalog_models import MODEL_QUERIES
from plumbrow.sources.views import LI4_FEATURES, LI_FEATURES, LI_KEY, LI_TIES, lineitem


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_is_a_projection(spark, sf):
    li = lineitem(spark, sf)
    for df in (
        sampling.stratified_split(li, "label", LI_KEY, ties=LI_TIES),
        sampling.stratified_folds(li, "label", LI_KEY, ties=LI_TIES),
        sampling.group_split(li, LI4_FEATURES),
        sampling.sample_uniform(li, LI_KEY, 100, LI_TIES),
    ):
        assert "Exchange" not in plan(df) and "Window" not in plan(df)


def test_ceiling_shuffles_once_by_vector(spark, sf):
    text = plan(audit.label_ceiling(lineitem(spark, sf), LI_FEATURES, "label"))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text
    read = text[text.index("ReadSchema"):].split("\n")[0]
    assert "l_tax" in read and "l_shipdate" not in read and "l_extendedprice" not in read


def test_class_filter_reaches_the_scan(spark, sf):
    text = plan(catalog.class_filter(spark, sf))
    assert "PushedFilters: [" in text and "EqualTo(event_type,error)" in text


def test_hot_groups_do_not_move(spark, sf):
    text = plan(audit.conflict_rows(lineitem(spark, sf), LI4_FEATURES, "label"))
    assert text.count("BroadcastHashJoin") >= 2


def test_one_aggregate_serves_the_audit(spark, sf):
    from plumbrow.plans.leakage import leakage_audit

    report = leakage_audit(lineitem(spark, sf), "label", LI4_FEATURES, LI_KEY, LI_TIES)
    assert plan(report).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", sorted(set(entry_points.queries()) - set(MODEL_QUERIES) - set(entry_points.LLM_QUERIES)))
def test_no_cross_join_and_no_row_udf(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_ranking_compares_no_row_with_all_bounds(spark, sf):
    """Scores find their bucket by range: no bound is spelt in the plan, whatever the number of buckets."""
    from plumbrow.operators import metrics

    scores = spark.range(3000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 7).alias("score"), F.lit("c").alias("config"))
    counts = metrics.score_counts(scores.withColumn("pred", F.lit(1)))
    few, many = (plan(metrics.ranking_metrics(counts, bucket_scores=n)) for n in (3000, 10))
    assert "percentile" not in many and "filter(" not in many.lower().replace("pushedfilters", "")
    assert len(many) < 1.1 * len(few)


def test_entry_stands_without_the_training_data_package():
    """As if the subpackage were not installed, with the pipeline file still there."""
    hide = (
        "import sys, importlib.abc\n"
        "class Hidden(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('plumbrow.llm'): raise ModuleNotFoundError(name)\n"
        "import importlib.util as u; find = u.find_spec\n"
        "u.find_spec = lambda n, p=None: None if n.startswith('plumbrow.llm') else find(n, p)\n"
        "sys.meta_path.insert(0, Hidden())\n"
        "import __spark_entry__ as e\n"
        "assert 'label_ceiling' in e.queries() and 'pipeline' not in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())\n"
    )
    root = Path(entry_points.__file__).parent
    subprocess.run([sys.executable, "-c", hide], cwd=root, check=True, timeout=120)
