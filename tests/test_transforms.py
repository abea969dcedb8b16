import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from plumbrow.operators import boundary, transforms
from plumbrow.operators.autoencoder import AdamState, AutoencoderFit, Network
from plumbrow.sources import sinks


def arrays(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "k long, z array<double>")


def result(df, c="out"):
    return np.array([r[c] for r in df.orderBy("k").select(c).collect()])


def test_constant_column(spark):
    df = arrays(spark, [[5, 1], [5, 3]])
    assert result(transforms.Standardize("z", "out").fit(df).transform(df)).tolist() == [[0, -1], [0, 1]]
    assert result(transforms.BoundedScale("z", "out").fit(df).transform(df)).tolist() == [[-1, -1], [-1, 1]]


def test_population_deviation(spark):
    values = np.random.default_rng(0).normal(size=(50, 3))
    df = arrays(spark, values)
    expect = (values - values.mean(0)) / values.std(0)
    assert np.allclose(result(transforms.Standardize("z", "out").fit(df).transform(df)), expect, atol=1e-12)


def test_training_state_ignores_other_rows(spark):
    train, test = arrays(spark, [[0.0], [10.0]]), arrays(spark, [[20.0], [-5.0]])
    model = transforms.BoundedScale("z", "out", clipped=False).fit(train)
    assert result(model.transform(test)).ravel().tolist() == [3.0, -2.0]
    clipped = model.copy({model.getParam("clipped"): True})
    assert result(clipped.transform(test)).ravel().tolist() == [1.0, -1.0]


def test_circle_and_inversion(spark):
    values = np.random.default_rng(1).uniform(-1, 1, size=(40, 4))
    df = transforms.AngularEncode("z", "out").transform(arrays(spark, values))
    encoded = result(df)
    assert encoded.shape == (40, 8)
    assert np.allclose(encoded[:, :4] ** 2 + encoded[:, 4:] ** 2, 1, atol=1e-12)
    assert np.allclose(result(df.withColumn("back", transforms.invert_angles(F.col("out"))), "back"), values, atol=1e-12)


def test_endpoint_pair_report(spark):
    row = boundary.boundary_report(arrays(spark, [[-1, 1], [2, 0.5], [-3, 0]]), "z").first()
    assert row["values_below_minus1_before_clipping"] == 1 and row["values_above_plus1_before_clipping"] == 1
    assert row["values_clipped_to_minus1"] == 2 and row["values_clipped_to_plus1"] == 2
    assert row["endpoint_collision_pairs"] == 2 and row["max_absolute_normalized_value_before_clipping"] == 3.0
    assert row["test_rows_with_at_least_one_out_of_range_value"] == 2
    assert row["inversion_error_max_interior_only"] < 1e-12


def test_quadratic_width_and_terms(spark):
    out = result(transforms.Quadratic("z", "out").transform(arrays(spark, [[2, 3, 5]])))[0]
    assert out.tolist() == [2, 3, 5, 4, 6, 10, 9, 15, 25]
    wide = transforms.Quadratic("z", "out").transform(arrays(spark, [[1] * 16]))
    assert result(wide).shape[1] == 152


def test_fourier_features_approximate_the_kernel(spark):
    values = np.random.default_rng(2).normal(size=(20, 3))
    df = arrays(spark, values)
    out = result(transforms.FourierFeatures("z", "out", gamma=0.3, dims=4000).fit(df).transform(df))
    kernel = np.exp(-0.3 * ((values[:, None] - values[None]) ** 2).sum(-1))
    assert np.abs(out @ out.T - kernel).max() < 0.12


def test_principal_components(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5))
    values = (values - values.mean(0)) / values.std(0)
    df = arrays(spark, values)
    latent = result(transforms.Principal("z", "out", k=2).fit(df).transform(df))
    assert np.isclose(latent.var(0).sum(), values.var(0).sum())


def test_cluster_columns(spark):
    df = arrays(spark, [[0, 0], [3, 4]])
    out = df.withColumn("d", transforms.center_distances(F.col("z"), [[0, 0], [3, 4]]))
    out = out.withColumn("h", transforms.nearest_one_hot(F.col("d"), 2))
    assert result(out, "d").tolist() == [[0, 5], [5, 0]] and result(out, "h").tolist() == [[1, 0], [0, 1]]


@pytest.mark.parametrize("latent", ["relu", "tanh"])
def test_gradient(latent):
    net = Network((4, 5, 2, 5, 4), ("relu", latent, "relu", "linear"))
    rng = np.random.default_rng(4)
    flat, x = net.start(1) + rng.normal(0, 0.05, net.size), rng.normal(size=(7, 4))
    got = net.gradient(flat, x)
    for i in range(0, net.size, 3):
        step = np.zeros(net.size)
        step[i] = 1e-6
        numeric = (net.loss_sum(flat + step, x) - net.loss_sum(flat - step, x)) / 2e-6 / len(x)
        assert got[i] == pytest.approx(numeric, abs=1e-6)


def test_adam_first_step():
    state = AdamState(np.zeros(2), np.zeros(2), np.zeros(2))
    state.advance(np.array([0.5, -2.0]), 0.001)
    assert np.allclose(state.weights, [-0.001, 0.001], atol=1e-8)


def test_parameter_counts():
    net = Network((100, 64, 32, 32, 32, 64, 100), ("relu", "relu", "tanh", "relu", "relu", "linear"))
    assert net.size == 19_268 and Network((100, 64, 32, 32), ("relu", "relu", "tanh")).size == 9_600


def correlated(spark, n=600):
    rng = np.random.default_rng(5)
    return arrays(spark, rng.normal(size=(n, 2)) @ rng.normal(size=(2, 8)))


def test_autoencoder_learns_and_repeats(spark):
    df = correlated(spark)
    settings = dict(key=["k"], hidden=(16, 8), latent=2, activation="tanh", batch=32, rowsPerTask=200, patience=30)
    few, many = (AutoencoderFit("z", "out", epochs=e, **settings).fit(df) for e in (1, 25))
    again = AutoencoderFit("z", "out", epochs=25, **settings).fit(df)
    assert np.allclose(many.getOrDefault("weights"), again.getOrDefault("weights"), atol=1e-9)
    assert not np.allclose(few.getOrDefault("weights"), many.getOrDefault("weights"))
    latent = result(many.transform(df))
    assert latent.shape == (600, 2) and np.abs(latent).max() <= 1


def test_training_lowers_the_loss(spark):
    from plumbrow.operators.autoencoder import fit_network
    from plumbrow.operators.sampling import validation_tail

    data = validation_tail(correlated(spark).withColumnRenamed("z", "x"), ["k"], out="held").select("x", "held")
    net = Network((8, 16, 2, 16, 8), ("relu", "tanh", "relu", "linear"), dropout=0.05)
    _, losses = fit_network(data.repartition(3).persist(), net, 20, 32, 20, 42)
    assert len(losses) == 20 and losses[-1] < 0.7 * losses[0]


def test_stored_models(spark, tmp_path):
    df = correlated(spark, 80)
    scale = transforms.Standardize("z", "x").fit(df)
    encoder = AutoencoderFit("x", "c", key=["k"], hidden=(8,), latent=3, epochs=1).fit(scale.transform(df))
    bound = transforms.BoundedScale("c", "n").fit(encoder.transform(scale.transform(df)))
    fourier = transforms.FourierFeatures("n", "f").fit(bound.transform(encoder.transform(scale.transform(df))))
    stages = [scale, encoder, bound, transforms.AngularEncode("n", "e"), transforms.Elementwise("e", "t", how="tanh"),
              transforms.Quadratic("n", "q"), fourier]
    model = PipelineModel(stages)
    sinks.save_model(model, str(tmp_path / "m"))
    back = sinks.load_model(str(tmp_path / "m"))
    for c in ("e", "t", "q", "f"):
        assert np.allclose(result(model.transform(df), c), result(back.transform(df), c))


def test_angle_of_pi_returns_the_endpoint():
    assert math.atan2(math.sin(math.pi), math.cos(math.pi)) / math.pi == 1.0
