"""Representation studies: fit on train, score the test side, compare by configuration.

Fitting is a sequence of Spark jobs per configuration; scoring ends in score counts, so the
tables that cross from one configuration to the report are small whatever the test side is.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from hashlib import md5

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrow.operators import metrics, transforms
from plumbrow.operators.autoencoder import AutoencoderFit
from plumbrow.operators.classifiers import CONFIGURATIONS, TOURNAMENT, Classifier, best_kmeans, cluster_columns, least_parts
from plumbrow.operators.sampling import sample_uniform
from plumbrow.operators.trials import TrialTable
from plumbrow.parallel import all_results, run_parallel
from plumbrow.session import cut, discard, release_shuffles, scratch_path, settle
from plumbrow.sources.files import union_tables


@dataclass(frozen=True)
class Latent:
    """How to learn the latent: an autoencoder, or principal components of the same width."""

    kind: str = "autoencoder"
    width: int = 16
    activation: str = "relu"
    hidden: tuple[int, ...] = (64, 32)
    dropout: float = 0.0
    epochs: int = 100
    batch: int = 256
    patience: int = 10
    max_rows: int = 0
    rows_per_task: int = 16_384
    seed: int = 42

    def estimator(self, key: Sequence[str], digest: str = ""):
        if self.kind == "pca":
            return transforms.Principal("x", "z", k=self.width)
        return AutoencoderFit(
            "x", "z", key=key, hidden=self.hidden, latent=self.width, activation=self.activation,
            dropout=self.dropout, epochs=self.epochs, batch=self.batch, patience=self.patience,
            maxRows=self.max_rows, rowsPerTask=self.rows_per_task, seed=self.seed, digest=digest,
        )


# The study's two autoencoders.
SMALL_LATENT = Latent()
WIDE_LATENT = Latent(width=32, activation="tanh", batch=512, epochs=40, patience=6)


@dataclass(frozen=True)
class Encoding:
    """Fitted stages from the feature array to the angles."""

    scaler: Model
    latent: Model
    bounds: Model

    def transform(self, df: DataFrame) -> DataFrame:
        """``x`` standardised, ``z`` latent, ``u`` scaled, ``n`` clipped, ``e`` cosines and sines."""
        rows = self.bounds.transform(self.latent.transform(self.scaler.transform(df)))
        width = len(self.bounds.getOrDefault("low"))
        rows = rows.withColumn("n", transforms.each(F.col("u"), width, lambda x, i: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))))
        return transforms.AngularEncode("n", "e", width).transform(rows)


def fit_encoding(train: DataFrame, features: str, key: Sequence[str], latent: Latent) -> Encoding:
    """Every stage sees training rows only."""
    scaler = transforms.Standardize(features, "x").fit(train)
    scaled = scaler.transform(train).select(*key, "x")
    if latent.kind == "pca":
        scaled = settle(scaled)
        model = latent.estimator(key).fit(scaled)
    else:  # the digest of a row is found once for all passes
        scaled = settle(scaled.withColumn("_digest", latent.estimator(key).order().digest(scaled)))
        model = latent.estimator(key, "_digest").fit(scaled)
    bounds = transforms.BoundedScale("z", "u", clipped=False).fit(model.transform(scaled))
    discard(scaled)
    release_shuffles(train.sparkSession)  # the network's rows were dealt
    return Encoding(scaler, model, bounds)


def encode_sides(
    df: DataFrame, features: str, key: Sequence[str], latent: Latent, label: str = "label", split: str = "split",
    columns: Sequence[str] = (),
) -> DataFrame:
    """Fit on the training side and store the encoded rows of both sides once, or only the named ``columns`` of them."""
    encoding = fit_encoding(df.filter(F.col(split) == "train"), features, key, latent)
    rows = encoding.transform(df)
    rows = rows.select(*key, F.col(label).alias("label"), F.col(split).alias("split"), "x", "z", "u", "n", "e")
    return settle(rows.select(*columns) if columns else rows)


def sides(df: DataFrame, test: str = "test") -> tuple[DataFrame, DataFrame]:
    return df.filter("split = 'train'"), df.filter(F.col("split") == test)


# ---------------------------------------------------------------- comparing configurations


@dataclass(frozen=True)
class Entry:
    """One configuration: train and test rows that share an array column, and a classifier."""

    config: str
    train: DataFrame
    test: DataFrame
    column: str
    classifier: Classifier


def scored_entry(entry: Entry) -> DataFrame:
    """Score counts of one configuration, with its width and training seconds."""
    begun = time.time()
    fitted = entry.classifier.fit(entry.train, entry.column)
    seconds = time.time() - begun
    dims = entry.train.select(F.size(entry.column).alias("d")).first()["d"]
    scored = fitted.score(entry.test.select("label", entry.column)).withColumn("config", F.lit(entry.config))
    counts = metrics.score_counts(scored.select("config", "label", "score", "pred"))
    return counts.withColumn("dims", F.lit(dims)).withColumn("train_seconds", F.lit(seconds))


def compare(entries: Sequence[Entry], parallelism: int = 4, isolate: bool = False) -> DataFrame:
    """Metrics by configuration. With ``isolate`` a failed entry becomes a row with its error."""
    results = run_parallel([lambda e=e: settle(scored_entry(e)) for e in entries], parallelism)
    errors = [(e.config, str(r)) for e, r in zip(entries, results) if isinstance(r, Exception)]
    if errors and not isolate:
        raise next(r for r in results if isinstance(r, Exception))
    parts = [r for r in results if not isinstance(r, Exception)]
    spark: SparkSession = entries[0].train.sparkSession
    if not parts:
        return spark.createDataFrame(errors, "config string, error string")
    counts = union_tables(parts)
    info = counts.groupBy("config").agg(F.first("dims").alias("dims"), F.first("train_seconds").alias("train_seconds"))
    report = info.join(metrics.full_metrics(counts.select("config", "score", "pred", "pos", "neg")), on="config")
    if not isolate:
        return report
    report = report.withColumn("error", F.lit(None).cast("string"))
    return union_tables([report, spark.createDataFrame(errors, "config string, error string")]) if errors else report


def representations(encoded: DataFrame, seed: int = 42) -> list[tuple[str, DataFrame, str]]:
    """The nine mappings as (name, table, column)."""
    one = lambda column, how: transforms.Elementwise(column, "f", how=how).transform(encoded)
    fourier = transforms.FourierFeatures("n", "f", seed=seed).fit(encoded.filter("split = 'train'"))
    return [
        ("raw", encoded, "x"),
        ("latent", encoded, "z"),
        ("latent scaled", encoded, "n"),
        ("latent tanh", one("z", "tanh"), "f"),
        ("latent cos", one("n", "cos"), "f"),
        ("latent sin", one("n", "sin"), "f"),
        ("latent angles", encoded, "e"),
        ("latent quadratic", transforms.Quadratic("n", "f").transform(encoded), "f"),
        ("latent fourier", fourier.transform(encoded), "f"),
    ]


def compare_representations(encoded: DataFrame, classifier: Classifier | None = None, parallelism: int = 4) -> DataFrame:
    """Nine mappings of one latent under the same classifier."""
    classifier = classifier or CONFIGURATIONS["RandomForest"]
    return compare([Entry(n, *sides(t), c, classifier) for n, t, c in representations(encoded)], parallelism)


def ablation(encoded: DataFrame, classifier: Classifier | None = None, parallelism: int = 4) -> DataFrame:
    """Raw, latent and encoded features under one classifier."""
    classifier = classifier or CONFIGURATIONS["svm"]
    names = (("raw", "x"), ("latent", "z"), ("encoded", "e"))
    return compare([Entry(n, *sides(encoded), c, classifier) for n, c in names], parallelism)


def baselines(encoded: DataFrame, classifiers: dict[str, Classifier] | None = None, parallelism: int = 4) -> DataFrame:
    """Forest, boosting and perceptron on the standardised features of the same split."""
    names = ("random_forest_ablation", "gradient_boosting", "mlp")
    classifiers = classifiers or {n: CONFIGURATIONS[n] for n in names}
    return compare([Entry(n, *sides(encoded), "x", c) for n, c in classifiers.items()], parallelism)


def tournament(encoded: DataFrame, classifiers: dict[str, Classifier] | None = None, parallelism: int = 4) -> DataFrame:
    """Every family on raw and on encoded features, ranked by attack F1; errors stay in their row."""
    from plumbrow.operators.ranking import leaderboard

    classifiers = classifiers or {n: CONFIGURATIONS[n] for n in TOURNAMENT}
    entries = [
        Entry(f"{name} {tag}", *sides(encoded), column, c)
        for name, c in classifiers.items() for tag, column in (("RAW", "x"), ("ENCODED", "e"))
    ]
    return leaderboard(compare(entries, parallelism, isolate=True))


def cross_validate(
    df: DataFrame, features: str, key: Sequence[str], latent: Latent, classifier: Classifier | None = None,
    k: int = 5, columns: dict[str, str] | None = None, fold: str = "fold", parallelism: int = 4,
) -> DataFrame:
    """Metrics by configuration and fold; every stage is fitted again for every fold."""
    classifier = classifier or CONFIGURATIONS["svm"]
    columns = columns or {"raw": "x", "latent": "z", "encoded": "e"}

    def one(f: int) -> DataFrame:
        split = F.when(F.col(fold) == f, "test").otherwise("train")
        encoded = encode_sides(df.withColumn("split", split), features, key, replace(latent, seed=latent.seed + f))
        entries = [Entry(name, *sides(encoded), c, classifier) for name, c in columns.items()]
        counts = union_tables([scored_entry(e) for e in entries])
        return settle(counts.withColumn("fold", F.lit(f)).select("config", "fold", "score", "pred", "pos", "neg"))

    results = all_results([lambda f=f: one(f) for f in range(k)], parallelism)
    return metrics.full_metrics(union_tables(results), ["config", "fold"])


def cluster_study(
    encoded: DataFrame, classifier: Classifier | None = None, starts: int = 10, parallelism: int = 4,
) -> DataFrame:
    """Angles alone, with standardised cluster distances, and with the one-hot cluster."""
    classifier = classifier or CONFIGURATIONS["svm"]
    model = best_kmeans(encoded.filter("split = 'train'"), "z", starts=starts)
    rows = cluster_columns(encoded, "z", model)
    rows = transforms.Standardize("dist", "ds").fit(rows.filter("split = 'train'")).transform(rows)
    rows = transforms.concat_arrays(transforms.concat_arrays(rows, ["e", "ds"], "b"), ["e", "hot"], "c")
    names = (("A encoded", "e"), ("B with distances", "b"), ("C with cluster", "c"))
    report = compare([Entry(n, *sides(rows), c, classifier) for n, c in names], parallelism)
    base = report.filter("config = 'A encoded'").select(F.col("accuracy").alias("base")).first()["base"]
    return report.withColumn("delta_accuracy", F.col("accuracy") - F.lit(base))


def audit_evaluator(
    features: str, key: Sequence[str], latent: Latent | None = None, classifier: Classifier | None = None,
    wide_above: int = 50,
) -> Callable[[DataFrame], DataFrame]:
    """Function for the leakage audit: the whole pipeline refitted on the training side of a split.

    Without ``latent`` the wide autoencoder serves more than ``wide_above`` features, else a narrow one.
    """
    classifier = classifier or CONFIGURATIONS["RandomForest"]

    def evaluate(df: DataFrame) -> DataFrame:
        chosen = latent
        if chosen is None:
            wide = df.select(F.size(features).alias("d")).first()["d"] > wide_above
            chosen = WIDE_LATENT if wide else replace(WIDE_LATENT, width=16)
        encoded = encode_sides(df, features, key, chosen, columns=("label", "split", "e"))
        train, test = sides(encoded)
        if classifier.family == "forest":  # pieces of the stored file, where the fit would deal and store all rows again
            train, _ = sides(cut(encoded, least_parts(train, "e", classifier.settings.get("trees", 200))))
        counts = scored_entry(Entry("pipeline", train, test, "e", classifier))
        report = metrics.full_metrics(counts.select("config", "score", "pred", "pos", "neg"))  # its score counts are stored
        discard(encoded)
        return report.drop("config", "pr_auc")

    return evaluate


# ---------------------------------------------------------------- grids and search


def architecture_grid(
    df: DataFrame, features: str, key: Sequence[str], latents: Sequence[Latent], classifier: Classifier,
    fit_rows: int = 15_000, parallelism: int = 4, seed: int = 42,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Latent width times activation; the classifier is fitted on ``fit_rows`` rows of the training side at most.

    Returns the metric table and the encoded table of every architecture.
    """
    names = [f"latent={x.width} act={x.activation}" for x in latents]
    tables = all_results([lambda x=x: encode_sides(df, features, key, x) for x in latents], parallelism)
    encoded = dict(zip(names, tables))
    entries = []
    for name, rows in encoded.items():
        train, test = sides(rows)
        entries.append(Entry(name, sample_uniform(train, key, fit_rows, seed=f"{seed}:grid"), test, "e", classifier))
    return compare(entries, parallelism), encoded


def margin_grid(
    encoded: DataFrame, key: Sequence[str], cs: Sequence[float] = (1, 10, 100),
    gammas: Sequence[str | float] = ("scale", 0.01, 0.1), fit_rows: int = 15_000, parallelism: int = 4,
    base: Classifier | None = None, seed: int = 42,
) -> DataFrame:
    """C times gamma of the margin classifier, balanced classes, fitted on ``fit_rows`` training rows at most."""
    base = base or Classifier("fourier_svm", {}, "balanced")
    train, test = sides(encoded)
    part = settle(sample_uniform(train, key, fit_rows, seed=f"{seed}:grid").select("label", "e"))
    entries = [Entry(f"C={c} gamma={g}", part, test, "e", base.with_settings(c=float(c), gamma=g)) for c in cs for g in gammas]
    return compare(entries, parallelism)


# Fixed values, the published search space: choices, a uniform range, and stepped ranges.
SEARCH_SPACE = {
    "h1": (64, 128, 256),
    "h2": (32, 64),
    "ldim": (24, 32, 48),
    "drop": (0.0, 0.3),
    "n_est": (150, 400, 50),
    "max_d": (10, 30),
}


SEARCH_TYPES = {"drop": "double", "h1": "int", "h2": "int", "ldim": "int", "max_d": "int", "n_est": "int"}


def draw_trials(n: int, seed: int = 42) -> list[dict]:
    """Seeded draws from the search space: every parameter by the digest of seed, trial number and name.

    The first 32 bits of the digest are a share of the range, so any engine draws the same trials.
    """

    def one(number: int) -> dict:
        share = lambda name: int(md5(f"{seed}:{number}:{name}".encode()).hexdigest()[:8], 16) / 2**32
        pick = lambda name, values: values[int(share(name) * len(values))]
        low, high, step = SEARCH_SPACE["n_est"]
        least, most = SEARCH_SPACE["max_d"]
        none, full = SEARCH_SPACE["drop"]
        return {
            "h1": pick("h1", SEARCH_SPACE["h1"]), "h2": pick("h2", SEARCH_SPACE["h2"]), "ldim": pick("ldim", SEARCH_SPACE["ldim"]),
            "drop": none + share("drop") * (full - none),
            "n_est": pick("n_est", range(low, high + 1, step)), "max_d": pick("max_d", range(least, most + 1)),
        }

    return [one(number) for number in range(n)]


def _trial_latent(params: dict, epochs: int, patience: int, seed: int, rows_per_task: int = 16_384) -> Latent:
    return Latent(
        width=params["ldim"], activation="tanh", hidden=(params["h1"], params["h2"]), dropout=params["drop"],
        epochs=epochs, batch=512, patience=patience, seed=seed, rows_per_task=rows_per_task,
    )


def _trial_forest(params: dict, seed: int) -> Classifier:
    return Classifier("forest", {"trees": params["n_est"], "depth": params["max_d"]}, "balanced", seed)


def random_search(
    dev: DataFrame, features: str, key: Sequence[str], trials: int = 20, epochs: int = 25, patience: int = 4,
    seed: int = 42, parallelism: int | None = None, path: str | None = None,
) -> DataFrame:
    """Seeded random search over autoencoder and forest; the objective is attack F1 on ``valid`` rows.

    ``dev`` has a ``split`` column with ``train`` and ``valid``. One row per trial. Trials are stored under ``path`` when they end; a
    search with the same path runs those that are missing.
    """
    spark = dev.sparkSession

    def objective(number: int, params: dict) -> float:
        encoded = encode_sides(dev, features, key, _trial_latent(params, epochs, patience, seed))
        train, valid = sides(encoded, "valid")
        counts = scored_entry(Entry(str(number), train, valid, "e", _trial_forest(params, seed)))
        return metrics.attack_metrics(counts).first()["attack_f1"]

    stored = TrialTable(spark, path or scratch_path(spark, "trials"), SEARCH_TYPES)
    table = stored.run(draw_trials(trials, seed), objective, parallelism)
    return table.withColumn("user_attrs_encoded_dim", 2 * F.col("params_ldim")).withColumn(
        "duration", F.col("datetime_complete") - F.col("datetime_start")
    )


def refit_best(
    df: DataFrame, features: str, key: Sequence[str], trials: DataFrame, epochs: int = 40, patience: int = 4, seed: int = 42,
) -> DataFrame:
    """Fit the best trial on the whole training side and report the test side."""
    from plumbrow.operators.ranking import best_trial

    best = best_trial(trials, "value", "number").first()
    params = {k: best[f"params_{k}"] for k in SEARCH_SPACE}
    encoded = encode_sides(df, features, key, _trial_latent(params, epochs, patience, seed))
    return compare([Entry(f"trial {best['number']}", *sides(encoded), "e", _trial_forest(params, seed))])
