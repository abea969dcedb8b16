"""Named queries over the benchmark tables, one or more per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrow.functions import columns as C
from plumbrow.operators import audit, boundary, clean, metrics, ranking, sampling, significance, transforms
from plumbrow.plans.leakage import leakage_audit
from plumbrow.plans.lookup import lookup_counts, lookup_fold_counts, train_prior, vector_folds, vector_sides
from plumbrow.session import scratch_path
from plumbrow.sources import files, manifest, sinks
from plumbrow.sources.views import (
    LI4_FEATURES, LI_FEATURES, LI_KEY, LI_TIES, documents, embeddings, events, lineitem, table,
)
from plumbrow.streaming.ingest import ingest_chunks, read_chunks, stream_files

FEATURE_SETS = {
    "q": LI_FEATURES[:1],
    "qd": LI_FEATURES[:2],
    "qdt": LI_FEATURES,
    "qdtl": LI4_FEATURES,
}


def _rounded(df: DataFrame, decimals: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round doubles for comparison with another engine; -0.0 becomes 0.0."""
    names = [n for n, t in df.dtypes if t == "double" and n not in skip]
    return df.withColumns({n: F.round(n, decimals) + F.lit(0.0) for n in names})


def _long_array(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per array position, rounded."""
    return _rounded(df.select(key, F.posexplode(column).alias("pos", "value")))


def _li_split(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    li = lineitem(spark, sf)
    model = sampling.fit_stratified_split(li, "label", LI_KEY, ties=LI_TIES)
    return model.transform(li, "split", ["test", "train"]), train_prior(model)


def _ev_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_split(events(spark, sf), "label", ["event_id"])


# ---------------------------------------------------------------- projections and labels


def drop_leaky_columns(spark, sf):
    li = table(spark, sf, "lineitem").drop("l_shipdate")
    return _rounded(clean.drop_leaky(li, ["l_orderkey", "l_partkey", "l_suppkey", "no_such_column"]))


def numeric_columns(spark, sf):
    orders = table(spark, sf, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return _rounded(clean.keep_numeric(orders, "label"))


def column_profile(spark, sf):
    return clean.column_profile(table(spark, sf, "lineitem"), "l_returnflag")


def provenance_label(spark, sf):
    pages = table(spark, sf, "pages")
    name = C.base_name(F.col("url"))
    return pages.select(
        "page_id",
        C.path_component(F.col("url"), "https:").cast("int").alias("under_folder"),
        clean.label_from_name(name, "1").alias("label_by_name"),
        C.contains_any(name, ["3", "7"]).cast("int").alias("matches_any"),
        C.has_suffix(F.col("url"), [".HTML", "5"]).cast("int").alias("has_suffix"),
    )


def typed_casts(spark, sf):
    li = clean.cast_features(lineitem(spark, sf), ["l_quantity", "l_linenumber"], "float")
    li = clean.cast_label(li, "label", "tinyint")
    return li.groupBy("label").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(F.col("l_linenumber").cast("long")).alias("lines")
    ).withColumn("label", F.col("label").cast("int"))


def class_filter(spark, sf):
    return clean.class_rows(events(spark, sf), "label", 1)


def class_names(spark, sf):
    named = events(spark, sf).select(C.code_names(F.col("label"), manifest.LABEL_NAMES).alias("class"))
    return named.groupBy("class").agg(F.count("*").alias("n"))


def threshold_predictions(spark, sf):
    scored = events(spark, sf).withColumn("score", F.col("value") / 100.0)
    return clean.with_prediction(scored, "score", 0.25).select("event_id", "pred")


def _dirty_events(spark, sf):
    """Events with infinities and missing values put in by rule."""
    v = F.col("value")
    dirty = (
        F.when(v > 200, float("inf")).when(v > 150, F.lit(None).cast("double")).when(v < 1, float("-inf"))
        .when(v < 3, float("nan")).otherwise(v)
    )
    return events(spark, sf).withColumn("value", dirty)


def inf_to_null(spark, sf):
    return _rounded(clean.inf_to_null(_dirty_events(spark, sf), ["value"]).select("event_id", "value"))


def impute_median(spark, sf):
    return _rounded(clean.impute_median(_dirty_events(spark, sf), ["value"]).select("event_id", "value"))


def impute_median_train(spark, sf):
    dirty = sampling.stratified_split(_dirty_events(spark, sf), "label", ["event_id"])
    filled = clean.impute_median(dirty, ["value"], fit_on=dirty.filter("split = 'train'"))
    return _rounded(filled.select("event_id", "split", "value"))


def impute_median_legacy(spark, sf):
    filled = clean.impute_median(_dirty_events(spark, sf), ["value"], legacy_inf=True)
    return _rounded(filled.select("event_id", "value"))


def feature_medians(spark, sf):
    li = lineitem(spark, sf)
    names = [*LI_FEATURES, "l_extendedprice"]
    found = clean.medians(li, names)
    wide = li.agg(*[F.lit(found[c]).alias(c) for c in names])
    return _rounded(significance.long_metrics(wide.withColumn("table", F.lit("lineitem")), ["table"], names))


def feature_moments(spark, sf):
    return _rounded(clean.moments(lineitem(spark, sf), [*LI_FEATURES, "l_extendedprice"]))


def class_weights(spark, sf):
    return _rounded(clean.class_weights(events(spark, sf), "label"))


def weighted_rows(spark, sf):
    ev = events(spark, sf)
    return _rounded(clean.with_weight(ev, "label", clean.fit_balance(ev, "label")).select("event_id", "weight"))


def positive_weight(spark, sf):
    ev = events(spark, sf)
    weight = clean.positive_weight(ev, "label")
    return _rounded(ev.groupBy("label").agg(F.count("*").alias("n")).withColumn("weight", F.lit(weight)))


# ---------------------------------------------------------------- set operations and joins


def union_by_name(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return files.union_tables([customers, suppliers])


def distinct_entities(spark, sf):
    ev = events(spark, sf).withColumn("entity", F.when(F.col("user_id") % 7 != 0, F.col("user_id")))
    return ev.select("entity").dropna().distinct()


def shared_vectors(spark, sf):
    li, _ = _li_split(spark, sf)
    return audit.shared_keys(li.filter("split = 'train'"), li.filter("split = 'test'"), LI4_FEATURES)


def attach_split(spark, sf):
    ev = events(spark, sf)
    assignment = sampling.stratified_split(ev, "label", ["event_id"]).select("event_id", "split")
    joined = sampling.attach_split(ev, assignment, ["event_id"])
    return _rounded(joined.groupBy("split").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


def string_functions(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        F.upper("lang").alias("lang"),
        F.replace("source", F.lit("a"), F.lit("_")).alias("source"),
        F.col("text").contains("the").cast("int").alias("has_the"),
        F.col("text").endswith(".").cast("int").alias("ends_sentence"),
    )


def hash_functions(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


def elapsed_seconds(spark, sf):
    spans = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return _rounded(spans.select("user_id", C.seconds_between(F.col("start"), F.col("end")).alias("seconds")))


def guarded_ratio(spark, sf):
    per = events(spark, sf).groupBy("user_id").agg(
        F.sum("label").alias("errors"), F.count(F.when(F.col("value") > 20, 1)).alias("large")
    )
    return _rounded(per.select("user_id", C.ratio(F.col("errors"), F.col("large")).alias("ratio")))


def elementwise_math(spark, sf):
    ev = events(spark, sf)
    v = F.col("value") / 10
    return _rounded(
        ev.select(
            "event_id", F.cos(v).alias("cosine"), F.sin(v).alias("sine"), F.tanh(v).alias("tanh"),
            (F.atan2(F.sin(v), F.cos(v)) / F.pi()).alias("turn"), C.round_even(F.col("value"), 0).alias("even"),
            C.clip(F.col("value"), 1.0, 20.0).alias("clipped"),
        )
    )


# ---------------------------------------------------------------- audit


def class_counts(spark, sf):
    return audit.class_counts(lineitem(spark, sf), "label")


def attack_rate_by_split(spark, sf):
    return audit.label_rate(_ev_split(spark, sf), "split", "label")


def attack_rate_by_entity(spark, sf):
    return audit.label_rate(events(spark, sf), "user_id", "label")


def duplicate_rate(spark, sf):
    return audit.duplicates(lineitem(spark, sf), LI4_FEATURES)


def duplicate_rate_text(spark, sf):
    docs = audit.hashed_vectors(table(spark, sf, "documents").select("doc_id", "text"), ["text"])
    return audit.duplicates(docs, ["vector"])


def duplicate_rows_flag(spark, sf):
    flagged = audit.flag_duplicates(lineitem(spark, sf), LI4_FEATURES, [*LI_KEY, *LI_TIES])
    return flagged.select(*LI_KEY, *LI_TIES, "is_duplicate")


def duplicate_documents_flag(spark, sf):
    docs = audit.hashed_vectors(table(spark, sf, "documents").select("doc_id", "text"), ["text"])
    return audit.flag_duplicates(docs, ["vector"], ["doc_id"])


def label_conflicts(spark, sf):
    return audit.label_conflicts(lineitem(spark, sf), LI4_FEATURES, "label")


def label_conflicts_text(spark, sf):
    docs = audit.hashed_vectors(documents(spark, sf).select("doc_id", "text", "label"), ["text"])
    return audit.label_conflicts(docs, ["vector"], "label")


def conflict_rows(spark, sf):
    return audit.conflict_rows(lineitem(spark, sf), LI4_FEATURES, "label").select(*LI_KEY, *LI_TIES, "label")


def unique_attack_vectors(spark, sf):
    return audit.unique_vectors(lineitem(spark, sf), LI4_FEATURES, "label")


def label_ceiling(spark, sf):
    return audit.label_ceiling(lineitem(spark, sf), LI_FEATURES, "label")


def label_ceiling_wide(spark, sf):
    return audit.label_ceiling(lineitem(spark, sf), LI4_FEATURES, "label")


def label_ceiling_rounded(spark, sf):
    return audit.label_ceiling(events(spark, sf), ["value"], "label", rounding=0)


def label_ceiling_text(spark, sf):
    docs = audit.hashed_vectors(documents(spark, sf, "toxic").select("doc_id", "text", "label"), ["text"])
    return audit.label_ceiling(docs, ["vector"], "label")


def vector_group_id(spark, sf):
    grouped = audit.with_group_id(lineitem(spark, sf), LI_FEATURES, mode="dense")
    return grouped.select(*LI_KEY, *LI_TIES, "group_id")


def vector_key_counts(spark, sf):
    keyed = audit.with_group_id(table(spark, sf, "documents"), ["text"])
    return keyed.groupBy("group_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).drop("group_id")


def overlap_random(spark, sf):
    return audit.overlap(_li_split(spark, sf)[0], LI4_FEATURES)


def overlap_grouped(spark, sf):
    return audit.overlap(sampling.group_split(lineitem(spark, sf), LI4_FEATURES), LI4_FEATURES)


def entity_overlap(spark, sf):
    ev = _ev_split(spark, sf).withColumn("entity", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    return audit.entity_overlap(ev, "entity")


def entity_overlap_documents(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", "label")
    return audit.entity_overlap(sampling.stratified_split(docs, "label", ["doc_id"]), "source")


def overlap_documents(spark, sf):
    docs = audit.hashed_vectors(documents(spark, sf).select("doc_id", "text", "label"), ["text"])
    return audit.overlap(sampling.stratified_split(docs, "label", ["doc_id"]), ["vector"])


def audit_report(spark, sf):
    report = leakage_audit(
        lineitem(spark, sf), "label", LI4_FEATURES, LI_KEY, LI_TIES, rounding=1, entity="l_suppkey"
    )
    return _rounded(report)


def metric_delta(spark, sf):
    """Lookup-scorer metrics under the stratified and the group-disjoint split."""
    li, prior = _li_split(spark, sf)
    grouped = sampling.group_split(lineitem(spark, sf), LI_FEATURES)
    parts = []
    for item, rows in (("random", li), ("group", grouped)):
        counts = lookup_counts(vector_sides(rows, LI_FEATURES), LI_FEATURES, item, prior)
        parts.append(audit.long_report(metrics.attack_metrics(counts).drop("config"), "metrics", item))
    return _rounded(audit.metric_delta(files.union_tables(parts), "metrics", "random", "group"))


# ---------------------------------------------------------------- samples and splits


def sample_fraction(spark, sf):
    return sampling.sample_fraction(events(spark, sf), "label", ["event_id"], {0: 0.1}).select("event_id", "label")


def sample_per_class(spark, sf):
    return sampling.sample_per_class(events(spark, sf), "label", ["event_id"], {0: 1500, 1: 700}).select("event_id", "label")


def sample_uniform(spark, sf):
    return sampling.sample_uniform(events(spark, sf), ["event_id"], 1000).select("event_id")


def stratified_split(spark, sf):
    return _li_split(spark, sf)[0].select(*LI_KEY, *LI_TIES, "label", "split")


def stratified_split_events(spark, sf):
    return _ev_split(spark, sf).select("event_id", "label", "split")


def dev_split(spark, sf):
    train = _ev_split(spark, sf).filter("split = 'train'").drop("split")
    return sampling.dev_split(train, "label", ["event_id"], rows=2000).select("event_id", "split")


def stratified_folds(spark, sf):
    return sampling.stratified_folds(events(spark, sf), "label", ["event_id"]).select("event_id", "label", "fold")


def group_split(spark, sf):
    return sampling.group_split(lineitem(spark, sf), LI_FEATURES).select(*LI_KEY, *LI_TIES, "split")


def validation_tail(spark, sf):
    return sampling.validation_tail(events(spark, sf), ["event_id"]).select("event_id", "is_valid")


# ---------------------------------------------------------------- transforms


def _emb(spark, sf) -> DataFrame:
    return sampling.stratified_split(embeddings(spark, sf), "label", ["vec_id"])


def _fit_emb(spark, sf, estimator) -> DataFrame:
    emb = _emb(spark, sf)
    return estimator.fit(emb.filter("split = 'train'")).transform(emb)


def _scaled(spark, sf, clipped=True) -> DataFrame:
    return _fit_emb(spark, sf, transforms.BoundedScale("z", "n", clipped))


def standardize(spark, sf):
    return _long_array(_fit_emb(spark, sf, transforms.Standardize("z", "out")), "vec_id", "out")


def minmax_clip(spark, sf):
    return _long_array(_scaled(spark, sf), "vec_id", "n")


def angular_encode(spark, sf):
    return _long_array(transforms.AngularEncode("n", "out").transform(_scaled(spark, sf)), "vec_id", "out")


def angular_inverse(spark, sf):
    encoded = transforms.AngularEncode("n", "e").transform(_scaled(spark, sf))
    return _long_array(encoded.withColumn("out", transforms.invert_angles(F.col("e"))), "vec_id", "out")


def _element(how: str, column: str):
    def run(spark, sf):
        source = _scaled(spark, sf) if column == "n" else embeddings(spark, sf)
        return _long_array(transforms.Elementwise(column, "out", how=how).transform(source), "vec_id", "out")

    return run


def poly2(spark, sf):
    squares = transforms.Quadratic("n", "out").transform(_scaled(spark, sf))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return _rounded(
        squares.select("vec_id", F.size("out").alias("dims"), total("out").alias("total"),
                       total(F.transform("out", lambda x: x * x)).alias("squares"),
                       F.element_at("out", 65).alias("first_square"), F.element_at("out", -1).alias("last_square"))
    )


def concat_features(spark, sf):
    both = transforms.concat_arrays(_scaled(spark, sf), ["z", "n"], "out")
    return _long_array(both, "vec_id", "out")


def boundary_report(spark, sf):
    rows = _scaled(spark, sf, clipped=False).filter("split = 'test'")
    report = boundary.boundary_report(rows, "n")
    return _rounded(report)


# ---------------------------------------------------------------- metrics


def _counts(spark, sf) -> DataFrame:
    li, prior = _li_split(spark, sf)
    sides = vector_sides(li, LI4_FEATURES)
    parts = [lookup_counts(sides, feats, name, prior) for name, feats in FEATURE_SETS.items()]
    return files.union_tables(parts)


def _metric(function):
    return lambda spark, sf: _rounded(function(_counts(spark, sf)))


def accuracy(spark, sf):
    return _rounded(metrics.attack_metrics(_counts(spark, sf)).select("config", "accuracy"))


def roc_auc(spark, sf):
    return _rounded(metrics.ranking_metrics(_counts(spark, sf)).select("config", "auc_roc"))


def average_precision(spark, sf):
    return _rounded(metrics.ranking_metrics(_counts(spark, sf)).select("config", "pr_auc"))


def scored_row_metrics(spark, sf):
    """Metrics from scored rows: every event scored by a fixed function of its value."""
    score = F.col("value") / (F.col("value") + 10)
    scored = events(spark, sf).select("event_id", "label", score.alias("score"), F.lit("value").alias("config"))
    return _rounded(metrics.full_metrics(metrics.score_counts(clean.with_prediction(scored))))


# ---------------------------------------------------------------- comparison


def _fold_metrics(spark, sf) -> DataFrame:
    li = lineitem(spark, sf)
    folds = sampling.fit_stratified_folds(li, "label", LI_KEY, ties=LI_TIES)
    per_fold = vector_folds(folds.transform(li, "fold"), LI4_FEATURES, 5)
    counts = files.union_tables([lookup_fold_counts(per_fold, f, c, folds, 5) for c, f in FEATURE_SETS.items()])
    wide = metrics.attack_metrics(counts, ["config", "fold"])
    return significance.long_metrics(wide, ["config", "fold"], ["accuracy", "attack_recall", "attack_f1"])


def fold_summary(spark, sf):
    return _rounded(significance.fold_summary(_fold_metrics(spark, sf)))


def paired_stats(spark, sf):
    return _rounded(significance.paired_statistics(_fold_metrics(spark, sf), "q", "qdtl").drop("ranks"), 4)


def paired_tests(spark, sf):
    return significance.paired_tests(_fold_metrics(spark, sf), "q", "qdtl")


def confidence_intervals(spark, sf):
    return _rounded(significance.confidence_intervals(_fold_metrics(spark, sf)))


def leaderboard(spark, sf):
    return _rounded(ranking.leaderboard(metrics.attack_metrics(_counts(spark, sf))))


def best_trial(spark, sf):
    trials = metrics.attack_metrics(_counts(spark, sf)).withColumn("trial", F.length("config"))
    return _rounded(ranking.best_trial(trials, "accuracy", "trial").select("trial", "config", "accuracy"))


def top_entities(spark, sf):
    per = lineitem(spark, sf).groupBy("l_suppkey").agg(F.sum(F.col("label") * 100000 + F.col("l_suppkey")).alias("value"))
    return ranking.top_k(per, "value", 10)


# ---------------------------------------------------------------- sources and manifest


def dataset_manifest(spark, sf):
    row = manifest.dataset_manifest(events(spark, sf), "label")
    return row.select(
        "rows", "columns_total", "label_column", "class_counts.benign", "class_counts.attack", "n_retained_features",
        F.array_join("retained_features", ",").alias("retained"), "n_excluded_columns", "split.n_train", "split.n_test",
    )


def dataset_manifest_full(spark, sf):
    orders = table(spark, sf, "orders").withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    return manifest.dataset_manifest(orders, "label")


def file_manifest(spark, sf):
    return files.file_manifest(spark, sf)


def csv_labelled_ingest(spark, sf):
    """Write both classes below labelled folders as CSV and read them back by folder."""
    root = scratch_path(spark, "captures")
    li = lineitem(spark, sf)
    for folder, value in (("Attacks/day1", 1), ("Benign/day1", 0)):
        sinks.write_table(li.filter(F.col("label") == value).drop("label"), f"{root}/{folder}", "csv")
    back = files.read_labelled(
        spark, root, F.col("path").isNotNull(),
        C.path_component(F.col("path"), files.ATTACK_FOLDER).cast("int"), li.drop("label").schema,
    )
    return _rounded(
        back.groupBy("label").agg(
            F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_extendedprice").alias("price")
        ), 2,
    )


def string_key_split(spark, sf):
    """A stratified split over a text key; debtors are the positive class."""
    rows = table(spark, sf, "customer").select("c_name", "c_mktsegment", (F.col("c_acctbal") < 0).cast("int").alias("label"))
    return sampling.stratified_split(rows, "label", ["c_name", "c_mktsegment"]).select("c_name", "split")


def chunked_ingest(spark, sf):
    """Stream the events in, keep a tenth of the benign rows, and count the store."""
    out = scratch_path(spark, "chunks")
    stream = stream_files(spark, sf, table(spark, sf, "events").schema, "parquet", "events.parquet")
    is_error = (F.col("event_type") == "error").cast("int")
    ingest_chunks(stream, F.col("path").isNotNull(), is_error, out, {0: 0.1}, ["event_id"])
    return read_chunks(spark, out).groupBy("label").agg(F.count("*").alias("n"))


def stored_assignment(spark, sf):
    """Split and fold assignment written as a table and read back."""
    ev = sampling.stratified_folds(_ev_split(spark, sf), "label", ["event_id"])
    path = scratch_path(spark, "assignment")
    sinks.write_assignment(ev, ["event_id"], ["split", "fold"], path)
    return spark.read.parquet(path).groupBy("split", "fold").agg(F.count("*").alias("n"))


QUERIES = {
    "drop_leaky_columns": drop_leaky_columns,
    "numeric_columns": numeric_columns,
    "column_profile": column_profile,
    "provenance_label": provenance_label,
    "typed_casts": typed_casts,
    "class_filter": class_filter,
    "class_names": class_names,
    "threshold_predictions": threshold_predictions,
    "inf_to_null": inf_to_null,
    "impute_median": impute_median,
    "impute_median_train": impute_median_train,
    "impute_median_legacy": impute_median_legacy,
    "feature_medians": feature_medians,
    "feature_moments": feature_moments,
    "class_weights": class_weights,
    "weighted_rows": weighted_rows,
    "positive_weight": positive_weight,
    "union_by_name": union_by_name,
    "distinct_entities": distinct_entities,
    "shared_vectors": shared_vectors,
    "attach_split": attach_split,
    "string_functions": string_functions,
    "hash_functions": hash_functions,
    "elapsed_seconds": elapsed_seconds,
    "guarded_ratio": guarded_ratio,
    "elementwise_math": elementwise_math,
    "class_counts": class_counts,
    "attack_rate_by_split": attack_rate_by_split,
    "attack_rate_by_entity": attack_rate_by_entity,
    "duplicate_rate": duplicate_rate,
    "duplicate_rate_text": duplicate_rate_text,
    "duplicate_rows_flag": duplicate_rows_flag,
    "duplicate_documents_flag": duplicate_documents_flag,
    "label_conflicts": label_conflicts,
    "label_conflicts_text": label_conflicts_text,
    "conflict_rows": conflict_rows,
    "unique_attack_vectors": unique_attack_vectors,
    "label_ceiling": label_ceiling,
    "label_ceiling_wide": label_ceiling_wide,
    "label_ceiling_rounded": label_ceiling_rounded,
    "label_ceiling_text": label_ceiling_text,
    "vector_group_id": vector_group_id,
    "vector_key_counts": vector_key_counts,
    "overlap_random": overlap_random,
    "overlap_grouped": overlap_grouped,
    "overlap_documents": overlap_documents,
    "entity_overlap": entity_overlap,
    "entity_overlap_documents": entity_overlap_documents,
    "audit_report": audit_report,
    "metric_delta": metric_delta,
    "sample_fraction": sample_fraction,
    "sample_per_class": sample_per_class,
    "sample_uniform": sample_uniform,
    "stratified_split": stratified_split,
    "stratified_split_events": stratified_split_events,
    "dev_split": dev_split,
    "stratified_folds": stratified_folds,
    "group_split": group_split,
    "validation_tail": validation_tail,
    "standardize": standardize,
    "minmax_clip": minmax_clip,
    "angular_encode": angular_encode,
    "angular_inverse": angular_inverse,
    "identity_map": _element("identity", "z"),
    "cos_only": _element("cos", "n"),
    "sin_only": _element("sin", "n"),
    "tanh_map": _element("tanh", "z"),
    "poly2": poly2,
    "concat_features": concat_features,
    "boundary_report": boundary_report,
    "accuracy": accuracy,
    "confusion": _metric(metrics.confusion),
    "per_class_prf": _metric(metrics.per_class),
    "macro_weighted": _metric(metrics.averaged),
    "attack_metrics": _metric(metrics.attack_metrics),
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "threshold_sweep": _metric(metrics.threshold_sweep),
    "brier": _metric(metrics.calibration),
    "scored_row_metrics": scored_row_metrics,
    "fold_summary": fold_summary,
    "paired_stats": paired_stats,
    "paired_tests": paired_tests,
    "confidence_intervals": confidence_intervals,
    "leaderboard": leaderboard,
    "best_trial": best_trial,
    "top_entities": top_entities,
    "dataset_manifest": dataset_manifest,
    "dataset_manifest_full": dataset_manifest_full,
    "file_manifest": file_manifest,
    "csv_labelled_ingest": csv_labelled_ingest,
    "chunked_ingest": chunked_ingest,
    "string_key_split": string_key_split,
    "stored_assignment": stored_assignment,
}
