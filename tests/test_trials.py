"""Stored trials and the tuning chain."""

import math

import pytest
from pyspark.sql import functions as F

from plumbrow.operators import ranking
from plumbrow.operators.classifiers import Classifier
from plumbrow.operators.trials import TrialTable
from plumbrow.plans import study, tuning
from plumbrow.session import scratch_path

TYPES = {"width": "int", "rate": "double"}
DRAWN = [{"width": n, "rate": n / 7} for n in range(6)]


def values(table):
    return [(r["number"], r["params_width"], r["params_rate"], r["value"], r["state"], r["error"]) for r in table.orderBy("number").collect()]


def objective(calls, broken=(), fatal=()):
    def run(number, params):
        if number in fatal:
            raise SystemExit("the driver ends")
        calls.append(number)
        if number in broken:
            raise ValueError("no fit")
        return params["rate"] + params["width"]

    return run


def test_a_killed_search_ends_with_the_same_table(spark):
    whole = TrialTable(spark, scratch_path(spark, "trials"), TYPES)
    expect = values(whole.run(DRAWN, objective([]), parallelism=1))
    path, first, second = scratch_path(spark, "trials"), [], []
    with pytest.raises(SystemExit):
        TrialTable(spark, path, TYPES).run(DRAWN, objective(first, fatal={3}), parallelism=1)
    stored = values(TrialTable(spark, path, TYPES).rows())
    assert stored[:3] == expect[:3] and 3 not in [r[0] for r in stored]
    got = values(TrialTable(spark, path, TYPES).run(DRAWN, objective(second), parallelism=2))
    assert got == expect and len(got) == 6
    assert sorted(first + second) == list(range(6))  # nothing ran twice
    third = []
    assert values(TrialTable(spark, path, TYPES).run(DRAWN, objective(third))) == expect and not third


def test_failed_trials_are_stored_and_retried_on_request(spark):
    table = TrialTable(spark, scratch_path(spark, "trials"), TYPES)
    got = values(table.run(DRAWN[:3], objective([], broken={1}), parallelism=3))
    assert [r[4] for r in got] == ["COMPLETE", "FAIL", "COMPLETE"] and got[1][3] is None and "no fit" in got[1][5]
    calls = []
    table.run(DRAWN[:3], objective(calls))
    assert calls == []
    assert table.missing(DRAWN[:3], retry_failed=True) == [1]
    listing = ranking.trial_listing(table.rows().withColumnRenamed("params_width", "params_ldim")).collect()
    assert [r["number"] for r in listing] == [0, 1, 2] and [r["encoded_dim"] for r in listing] == [0, 2, 4]


def test_other_parameters_are_refused(spark):
    path = scratch_path(spark, "trials")
    TrialTable(spark, path, TYPES).run(DRAWN[:2], objective([]))
    with pytest.raises(ValueError, match="was drawn as"):
        TrialTable(spark, path, TYPES).run([DRAWN[0], {"width": 1, "rate": 0.5}], objective([]))


def test_two_drivers_count_once(spark):
    path = scratch_path(spark, "trials")
    a, b = TrialTable(spark, path, TYPES), TrialTable(spark, path, TYPES)
    a.write(0, DRAWN[0], 0.25, "COMPLETE", None, 1.0)
    b.write(0, DRAWN[0], 0.75, "COMPLETE", None, 2.0)
    assert values(a.rows()) == values(b.rows()) == [(0, 0, 0.0, 0.25, "COMPLETE", None)]
    assert a.attempts().first()["attempts"] == 2


def test_unfinished_attempts_hold_no_row(spark):
    path = scratch_path(spark, "trials")
    table = TrialTable(spark, path, TYPES)
    table.run(DRAWN[:1], objective([]))
    spark.createDataFrame([(1, 1, 0.1, 1.0, "COMPLETE", None, None, None)], table.schema).write.parquet(f"{path}/000001-dead/_temporary/0/attempt")
    assert [r[0] for r in values(table.rows())] == [0]


def test_first_of_equal_values_wins():
    assert tuning.first_best([0.2, 0.7, None, 0.7]) == 1
    assert tuning.first_best([None, None]) == 0
    assert tuning.first_best([None, 0.0]) == 1


def test_chain_hands_on_its_winner(spark):
    from plumbrow.operators import sampling

    rows = spark.range(400).select(
        F.col("id").alias("vec_id"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        F.array(*[F.sin(F.col("id") * k) + (F.col("id") % 3 == 0).cast("int") * k for k in (1, 2, 3)]).alias("z"),
    )
    table = sampling.stratified_split(rows, "label", ["vec_id"])
    latents = tuning.grid_latents(study.Latent(hidden=(8,), epochs=2), widths=(2, 3), activations=("relu", "tanh"))
    svm = Classifier("fourier_svm", {"dims": 32, "rounds": 10})
    chain = tuning.TuningChain(latents, cs=(1, 10), gammas=("scale", 0.1), base=svm, baseline=Classifier("forest", {"trees": 5, "depth": 4}, "balanced"), fit_rows=100)
    tuned = chain.fit(table, "z", ["vec_id"])
    report = tuned.report.orderBy("stage", "trial").collect()
    assert [(r["stage"], r["trial"]) for r in report] == [("architecture", n) for n in range(4)] + [("baseline", 0), ("final", 0)] + [("margin", n) for n in range(4)]
    for stage in ("architecture", "margin"):
        own = [r for r in report if r["stage"] == stage]
        assert [r["trial"] for r in own if r["chosen"]] == [tuning.first_best([r["attack_f1"] for r in own])]
        assert {r["fit_rows"] for r in own} == {100}
    won = next(r for r in report if r["stage"] == "architecture" and r["chosen"])
    assert won["dims"] == 2 * tuned.latent.width and won["config"] == f"latent={tuned.latent.width} act={tuned.latent.activation}"
    assert {r["dims"] for r in report if r["stage"] in ("margin", "final")} == {won["dims"]}
    margin = next(r for r in report if r["stage"] == "margin" and r["chosen"])
    settings = tuned.classifier.settings
    assert margin["config"] in (f"C={int(settings['c'])} gamma={settings['gamma']}",) and tuned.classifier.weighting == "balanced"
    final = next(r for r in report if r["stage"] == "final")
    assert final["fit_rows"] == 320 and final["valid_rows"] == 80
    scored = tuned.score()
    assert scored.count() == 80
    assert math.isclose(scored.agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0], final["accuracy"])
