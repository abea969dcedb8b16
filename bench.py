"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from plumbrow.operators import sampling
from plumbrow.operators.transforms import assemble
from plumbrow.plans import study
from plumbrow.plans.catalog import QUERIES
from plumbrow.plans.catalog_models import MODEL_QUERIES
from plumbrow.session import local_session, settle
from plumbrow.sources.views import LI4_FEATURES, LI_KEY, lineitem

HEADLINE = [
    "label_ceiling", "label_ceiling_wide", "audit_report", "duplicate_rate", "duplicate_rate_text", "conflict_rows",
    "overlap_random", "overlap_grouped", "entity_overlap", "stratified_split", "stratified_folds", "group_split",
    "impute_median", "feature_medians", "feature_moments", "standardize", "angular_encode", "boundary_report",
    "attack_metrics", "roc_auc", "average_precision", "threshold_sweep", "fold_summary", "scored_row_metrics",
    "lineitem_forest_metrics", "pca_latent", "autoencoder_latent", "svm_rff_scores",
]


def search_trial(spark, sf: str):
    """One search trial at the published size: a 110,000-row development set, split 75/25."""
    li = assemble(lineitem(spark, sf), [*LI4_FEATURES, "l_extendedprice"], "f")
    key = [*LI_KEY, "l_extendedprice"]
    dev = settle(sampling.dev_split(li, "label", key, rows=110_000).repartition(*key))
    return study.random_search(dev, "f", key, trials=1)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or [*HEADLINE, "search_trial"]
    known = {**QUERIES, **MODEL_QUERIES, "search_trial": search_trial}
    spark.read.parquet(f"{sf}/lineitem.parquet").agg({"l_quantity": "sum"}).collect()
    seconds = {}
    started = time.time()
    for name in chosen:
        if time.time() - started > float(os.environ.get("BENCH_BUDGET", "1200")):
            print(f"{name} left out: over the time budget", file=sys.stderr, flush=True)
            continue
        begun = time.time()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begun, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    out = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")),
    }
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
