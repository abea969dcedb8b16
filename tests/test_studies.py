import pytest
from pyspark.sql import functions as F

from plumbrow.operators import sampling
from plumbrow.operators.classifiers import Classifier, best_kmeans
from plumbrow.plans import explain, study

KEY = ["k"]


@pytest.fixture(scope="module")
def table(spark):
    """Two clouds that a classifier must tell apart, with two useless positions."""
    label = (F.col("id") % 2).cast("int")
    z = F.array(F.randn(1) + label * 4, F.randn(2) - label * 3, F.randn(3), F.randn(4))
    df = spark.range(400).select(F.col("id").alias("k"), z.alias("z"), label.alias("label")).persist()
    yield sampling.stratified_split(df, "label", KEY)
    df.unpersist()


@pytest.fixture(scope="module")
def encoded(table):
    return study.encode_sides(table, "z", KEY, study.Latent(kind="pca", width=3))


FOREST = Classifier("forest", {"trees": 10, "depth": 6}, "balanced")
SVM = Classifier("fourier_svm", {"dims": 64, "rounds": 20})


@pytest.mark.parametrize("clf", [
    FOREST, SVM, Classifier("boosting", {"rounds": 5, "depth": 3}, "positive"),
    Classifier("perceptron", {"hidden": (8,), "rounds": 50}), Classifier("logistic"),
], ids=lambda c: c.family)
def test_classifiers_beat_the_majority(encoded, clf):
    train, test = study.sides(encoded)
    scored = clf.fit(train, "x").score(test)
    assert scored.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0] > 0.85


def test_nine_representations(encoded):
    report = study.compare_representations(encoded, FOREST).collect()
    dims = {r["config"]: r["dims"] for r in report}
    assert len(dims) == 9 and sorted(dims.values()) == [3, 3, 3, 3, 3, 4, 6, 6, 9]


def test_errors_stay_in_their_row(encoded):
    bad = Classifier("forest", {"trees": 2, "depth": 99})
    board = study.tournament(encoded, {"good": FOREST, "bad": bad}).collect()
    errors = {r["config"]: r["error"] for r in board}
    assert errors["bad RAW"] and errors["bad ENCODED"] and errors["good RAW"] is None
    assert [r["place"] for r in board if r["error"] is None][0] == 1


def test_search_and_refit(table):
    train = table.filter("split = 'train'").drop("split")
    dev = sampling.dev_split(train, "label", KEY, rows=200)
    trials = study.random_search(dev, "z", KEY, trials=1, epochs=1)
    row = trials.first()
    assert row["state"] == "COMPLETE" and row["user_attrs_encoded_dim"] == 2 * row["params_ldim"]
    assert study.refit_best(table, "z", KEY, trials, epochs=1).first()["accuracy"] > 0.5


def test_draws_stay_in_the_space():
    for t in study.draw_trials(50):
        assert t["h1"] in (64, 128, 256) and t["n_est"] in range(150, 401, 50) and 10 <= t["max_d"] <= 30
        assert 0 <= t["drop"] <= 0.3
    assert study.draw_trials(3) == study.draw_trials(3)


def test_permutation_finds_the_useful_positions(table, spark):
    train, test = study.sides(table)
    fitted = FOREST.fit(train, "z")
    got = {r["feature"]: r["importance"] for r in explain.permutation_importance(fitted, test, list("abcd"), KEY).collect()}
    assert max(got["a"], got["b"]) > max(got["c"], got["d"]) and len(got) == 4
    impurity = explain.impurity_importance(fitted, list("abcd"), spark).agg(F.sum("importance")).first()[0]
    assert impurity == pytest.approx(1.0)


def test_clusters_and_study(encoded):
    train, _ = study.sides(encoded)
    assert best_kmeans(train, "z", starts=2).summary.k == 2
    report = {r["config"]: r["delta_accuracy"] for r in study.cluster_study(encoded, SVM, starts=1).collect()}
    assert report["A encoded"] == 0.0 and len(report) == 3


def test_cross_validation_covers_all_rows(table):
    folds = sampling.stratified_folds(table.drop("split"), "label", KEY, k=3)
    report = study.cross_validate(folds, "z", KEY, study.Latent(kind="pca", width=2), FOREST, k=3, columns={"raw": "x"})
    assert sorted(r["fold"] for r in report.collect()) == [0, 1, 2]


def test_grids(table, encoded):
    latents = [study.Latent(width=2, activation=a, hidden=(8,), epochs=1) for a in ("relu", "tanh")]
    report, tables = study.architecture_grid(table, "z", KEY, latents, SVM, fit_rows=100)
    assert report.count() == 2 and len(tables) == 2
    assert study.margin_grid(encoded, KEY, cs=(1, 10), gammas=("scale",), fit_rows=100, base=SVM).count() == 2


def test_forest_profile(encoded):
    train, test = study.sides(encoded)
    row = explain.profile_forest("f", FOREST.fit(train, "x"), test, 1.0).first()
    assert row["trees"] == 10 and row["nodes"] > 10 and row["stored_mb"] > 0 and row["accuracy"] > 0.8


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000])
def test_shuffles_are_one_to_one(n):
    import numpy as np

    from plumbrow.functions.permutation import permuted

    numbers = np.arange(n)
    images = [permuted(numbers, n, f"k{k}") for k in range(3)]
    for image in images:
        assert sorted(image) == list(range(n))
        assert list(permuted(numbers[n // 2 :], n, "k0")) == list(images[0][n // 2 :])  # any part of the rows, on any task
    if n >= 64:
        assert (images[0] != images[1]).mean() > 0.8 and abs(np.corrcoef(numbers, images[0])[0, 1]) < 0.4


def test_shuffles_take_one_feature_at_a_time(table, spark):
    """No job scores more rows than the repeats of one feature, and a feature that nothing reads costs nothing."""
    train, test = study.sides(table)
    fitted, seen = FOREST.fit(train, "z"), []

    class Counting:
        column, model = fitted.column, fitted.model

        def score(self, df):
            seen.append(df.count())
            return fitted.score(df)

    got = explain.permutation_importance(Counting(), test, list("abcd"), KEY, repeats=3)
    n = test.count()
    assert sorted(seen) == [n] + [3 * n] * 4
    again = explain.permutation_importance(fitted, test, list("abcd"), KEY, repeats=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    constant = test.withColumn("z", F.transform("z", lambda x, i: F.when(i == 0, F.lit(1.5)).otherwise(x)))
    still = {r["feature"]: r for r in explain.permutation_importance(fitted, constant, list("abcd"), KEY, repeats=2).collect()}
    assert still["a"]["importance"] == pytest.approx(0, abs=1e-12) and still["a"]["std"] == 0
