"""Named queries that fit models. Budgets (epochs, trees, rounds, trials) are kept small.

All rows of the tables are read; the two grids fit their classifier on 15,000 training rows at most.
"""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window, functions as F

from plumbrow.operators import ranking, sampling, significance, transforms
from plumbrow.operators.classifiers import (
    CONFIGURATIONS, Classifier, best_kmeans, cluster_columns, margin_to_probability,
)
from plumbrow.operators.trials import TrialTable
from plumbrow.plans import explain, study
from plumbrow.plans.leakage import leakage_audit
from plumbrow.plans.tuning import TuningChain
from plumbrow.session import discard, scratch_path, settle
from plumbrow.sources import sinks
from plumbrow.sources.views import LI4_FEATURES, LI_KEY, LI_TIES, embeddings, lineitem

KEY = ["vec_id"]
NAMES = [f"z{i}" for i in range(64)]
SMALL_FOREST = Classifier("forest", {"trees": 50, "depth": 12}, "balanced")
SMALL_SVM = Classifier("fourier_svm", {"c": 10.0, "gamma": "scale", "dims": 128, "rounds": 30}, "balanced")
PCA16 = study.Latent(kind="pca", width=16)
AE16 = study.Latent(width=16, activation="tanh", epochs=8, batch=64, patience=3)


def _emb(spark, sf) -> DataFrame:
    return sampling.stratified_split(embeddings(spark, sf), "label", KEY)


def _encoded(spark, sf, latent: study.Latent = PCA16) -> DataFrame:
    return study.encode_sides(_emb(spark, sf), "z", KEY, latent)


def _scores(name: str, **settings):
    """Scored test rows of one study configuration on the standardised embeddings."""

    def run(spark, sf):
        train, test = study.sides(_emb(spark, sf))
        scaler = transforms.Standardize("z", "x").fit(train)
        fitted = CONFIGURATIONS[name].with_settings(**settings).fit(settle(scaler.transform(train)), "x")
        return fitted.score(scaler.transform(test)).select("vec_id", "label", "score", "pred")

    return run


def _spread(df: DataFrame) -> DataFrame:
    """One shuffle by the unique row key into a stored table, so that every pass of a fit is even."""
    return settle(df.repartition(*LI_KEY, *LI_TIES), release=True)


def lineitem_forest_metrics(spark, sf):
    li = transforms.assemble(lineitem(spark, sf), [*LI4_FEATURES, "l_extendedprice"], "f")
    train, test = study.sides(_spread(sampling.stratified_split(li, "label", LI_KEY, ties=LI_TIES)))
    forest = Classifier("forest", {"trees": 20, "depth": 8}, "balanced")
    return study.compare([study.Entry("forest", train, test, "f", forest)]).drop("train_seconds")


def platt_probability(spark, sf):
    train, test = study.sides(_encoded(spark, sf))
    fitted = SMALL_SVM.fit(train, "e")
    return margin_to_probability(fitted.score(test), fitted.score(train)).select("vec_id", "label", "score", "pred")


def kmeans_profile(spark, sf):
    train, _ = study.sides(_encoded(spark, sf))
    model = best_kmeans(train, "z")
    rows = cluster_columns(train, "z", model)
    return rows.groupBy(F.array_position("hot", 1.0).alias("cluster")).agg(
        F.count("*").alias("n"), F.avg(F.array_min("dist")).alias("mean_distance")
    ).withColumn("inertia", F.lit(model.summary.trainingCost))


def pca_latent(spark, sf):
    return _encoded(spark, sf).select("vec_id", "split", F.posexplode("z").alias("pos", "value"))


def autoencoder_latent(spark, sf):
    return _encoded(spark, sf, AE16).select("vec_id", "split", F.posexplode("z").alias("pos", "value"))


def fourier_features(spark, sf):
    encoded = _encoded(spark, sf)
    model = transforms.FourierFeatures("n", "f").fit(encoded.filter("split = 'train'"))
    return model.transform(encoded).select("vec_id", F.posexplode("f").alias("pos", "value"))


def cluster_features(spark, sf):
    encoded = _encoded(spark, sf)
    return cluster_columns(encoded, "z", best_kmeans(encoded.filter("split = 'train'"), "z")).select("vec_id", "dist", "hot")


def compare_representations(spark, sf):
    return study.compare_representations(_encoded(spark, sf, AE16), SMALL_FOREST)


def ablation(spark, sf):
    return study.ablation(_encoded(spark, sf, AE16), SMALL_SVM)


def baselines(spark, sf):
    small = {
        "random_forest": SMALL_FOREST,
        "gradient_boosting": Classifier("boosting", {"rounds": 10, "depth": 3}),
        "mlp": Classifier("perceptron", {"hidden": (64, 32), "rounds": 50}),
    }
    return study.baselines(_encoded(spark, sf), small)


def tournament(spark, sf):
    small = {
        name: CONFIGURATIONS[name].with_settings(**({"trees": 50, "depth": 12} if name == "RandomForest" else {"rounds": 5}))
        for name in ("RandomForest", "HistGradBoost", "XGBoost", "LightGBM")
    }
    return study.tournament(_encoded(spark, sf), small)


def cross_validation(spark, sf):
    folds = sampling.stratified_folds(embeddings(spark, sf), "label", KEY)
    return study.cross_validate(folds, "z", KEY, PCA16, SMALL_SVM, columns={"raw": "x", "encoded": "e"})


def paired_model_tests(spark, sf):
    """Raw against encoded features over shared folds."""
    wide = cross_validation(spark, sf)
    long = significance.long_metrics(wide, ["config", "fold"], ["accuracy", "auc_roc", "attack_recall"])
    return significance.paired_tests(settle(long), "raw", "encoded")


def cluster_study(spark, sf):
    return study.cluster_study(_encoded(spark, sf), SMALL_SVM, starts=3)


def architecture_grid(spark, sf):
    latents = [study.Latent(width=w, activation=a, epochs=3, batch=64) for w in (16, 32) for a in ("relu", "tanh")]
    report, _ = study.architecture_grid(_emb(spark, sf), "z", KEY, latents, SMALL_SVM)
    return report


def margin_grid(spark, sf):
    return study.margin_grid(_encoded(spark, sf), KEY, base=SMALL_SVM)


def _trials(spark, sf, trials: int) -> DataFrame:
    train = _emb(spark, sf).filter("split = 'train'").drop("split")
    dev = sampling.dev_split(train, "label", KEY)
    return study.random_search(dev, "z", KEY, trials=trials, epochs=3)


def random_search(spark, sf):
    return ranking.trial_listing(_trials(spark, sf, 2)).drop("duration")


def trial_listing(spark, sf):
    """A search of two trials, and one of four over the same table, which runs the two that are missing."""
    train = _emb(spark, sf).filter("split = 'train'").drop("split")
    dev = settle(sampling.dev_split(train, "label", KEY))
    path = scratch_path(spark, "trials")
    for trials in (2, 4):
        table = study.random_search(dev, "z", KEY, trials=trials, path=path)
    attempts = TrialTable(spark, path, study.SEARCH_TYPES).attempts()
    return ranking.trial_listing(table.join(attempts, "number")).select(
        "number", *[f"params_{n}" for n in study.SEARCH_TYPES], "encoded_dim", "state", "attempts",
        F.col("value").between(0, 1).alias("scored"), (F.col("seconds") > 0).alias("timed"),
    )


def tuning_chain(spark, sf):
    """Rows of a staged tuning that do not depend on the fits: grids, sizes, and whether the winners follow the rule."""
    report = TuningChain().fit(_emb(spark, sf), "z", KEY).report
    stage = Window.partitionBy("stage")
    best = F.row_number().over(stage.orderBy(F.desc_nulls_last("attack_f1"), "trial")) == 1
    width = F.max(F.when((F.col("stage") == "architecture") & F.col("chosen"), F.col("dims"))).over(Window.partitionBy(F.col("stage") == ""))
    rows = report.withColumn("best", best).withColumn("width", width)
    return rows.select(
        "stage", "trial", "config", F.when(F.col("stage") == "architecture", F.col("dims")).otherwise(0).alias("dims"), "fit_rows", "valid_rows",
        F.when(F.col("stage") == "baseline", ~F.col("chosen")).otherwise(F.col("chosen") == F.col("best")).alias("by_rule"),
        F.when(F.col("stage") == "baseline", F.col("dims") == 64).when(F.col("stage") == "architecture", True)
        .otherwise(F.col("dims") == F.col("width")).alias("handed_on"),
        (F.col("accuracy").between(0, 1) & F.col("auc_roc").between(0, 1) & F.col("attack_f1").between(0, 1)).alias("scored"),
    )


def search_refit(spark, sf):
    return study.refit_best(_emb(spark, sf), "z", KEY, _trials(spark, sf, 1), epochs=3)


def impurity_importance(spark, sf):
    train, _ = study.sides(_emb(spark, sf))
    return ranking.top_k(explain.impurity_importance(SMALL_FOREST.fit(train, "z"), NAMES, spark), "importance")


def permutation_importance(spark, sf):
    train, test = study.sides(_emb(spark, sf))
    fitted = SMALL_FOREST.with_settings(trees=20).fit(train, "z")
    return ranking.top_k(explain.permutation_importance(fitted, test, NAMES, KEY), "importance")


def model_profile(spark, sf):
    encoded = _encoded(spark, sf)
    train, test = study.sides(encoded)
    parts = []
    for name, column in (("forest on encoded", "e"), ("forest on raw", "x")):
        begun = time.time()
        fitted = SMALL_FOREST.fit(train, column)
        parts.append(explain.profile_forest(name, fitted, test, time.time() - begun))
    begun = time.time()
    encoder = AE16.estimator(KEY).fit(train)
    parts.append(explain.profile_encoder("autoencoder", encoder, train, time.time() - begun))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stored_pipeline(spark, sf):
    """Fit scaling, latent, bounds and angles, store the pipeline, load it and score all rows."""
    emb = _emb(spark, sf)
    encoding = study.fit_encoding(emb.filter("split = 'train'"), "z", KEY, PCA16)
    path = scratch_path(spark, "pipeline")
    bounds = encoding.bounds.copy({encoding.bounds.getParam("clipped"): True})
    stages = [encoding.scaler, encoding.latent, bounds, transforms.AngularEncode("u", "e")]
    sinks.save_model(PipelineModel(stages), path)
    scored = sinks.load_model(path).transform(emb.select("vec_id", F.col("z").alias("z")))
    return scored.select("vec_id", F.posexplode("e").alias("pos", "value"))


def evaluated_audit(spark, sf):
    """The audit with scaling, autoencoder, angles and forest fitted again under both splits."""
    li = _spread(transforms.assemble(lineitem(spark, sf), LI4_FEATURES, "f"))
    evaluate = study.audit_evaluator(
        "f", [*LI_KEY, *LI_TIES], study.Latent(width=4, activation="tanh", batch=512, epochs=3),
        Classifier("forest", {"trees": 10, "depth": 8}, "balanced"),
    )

    def evaluate_splits(df: DataFrame) -> DataFrame:
        discard(li)  # the audit has stored its rows with both splits
        return evaluate(df)

    report = leakage_audit(li, "label", LI4_FEATURES, LI_KEY, LI_TIES, entity="l_suppkey", evaluate=evaluate_splits)
    path = scratch_path(spark, "report")
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


MODEL_QUERIES = {
    "rf_scores": _scores("RandomForest", trees=100, depth=20),
    "gbt_scores": _scores("gradient_boosting", rounds=20),
    "hist_boosting_scores": _scores("HistGradBoost", rounds=10),
    "deep_boosting_scores": _scores("XGBoost", rounds=10),
    "svm_rff_scores": _scores("svm"),
    "mlp_scores": _scores("mlp", rounds=100),
    "lineitem_forest_metrics": lineitem_forest_metrics,
    "platt_probability": platt_probability,
    "kmeans_profile": kmeans_profile,
    "pca_latent": pca_latent,
    "autoencoder_latent": autoencoder_latent,
    "fourier_features": fourier_features,
    "cluster_features": cluster_features,
    "compare_representations": compare_representations,
    "ablation": ablation,
    "baselines": baselines,
    "tournament": tournament,
    "cross_validation": cross_validation,
    "paired_model_tests": paired_model_tests,
    "cluster_study": cluster_study,
    "architecture_grid": architecture_grid,
    "margin_grid": margin_grid,
    "random_search": random_search,
    "search_refit": search_refit,
    "trial_listing": trial_listing,
    "tuning_chain": tuning_chain,
    "impurity_importance": impurity_importance,
    "permutation_importance": permutation_importance,
    "model_profile": model_profile,
    "stored_pipeline": stored_pipeline,
    "evaluated_audit": evaluated_audit,
}
