"""Own stages, feature preparation and evaluation."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidemark.features import evaluate as E
from tidemark.features import prepare as P
from tidemark.features.stages import ExtremeValueCapper, ExtremeValueCapperModel, ScalarNAFiller, cap_column, fill_column
from tidemark.plans import recipes as R
from tidemark.sources.tables import recipes
from tidemark.storage import new_folder


@pytest.fixture(scope="module")
def four(spark):
    rows = [(10, 7, None, 2), (14, 9, 21, 2), (20, 31, 8, 0), (12, 5, None, 6)]
    return spark.createDataFrame(rows, "one int, two int, three int, four int")


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_filler_forms_agree(four):
    filler = ScalarNAFiller(inputCol="three", outputCol="filled", filler=0.5)
    # A fraction is not cut off, though the column holds whole numbers.
    assert column(filler.transform(four), "filled") == [0.5, 21.0, 8.0, 0.5]
    assert column(fill_column(four, "three", "filled", 0.5), "filled") == [0.5, 21.0, 8.0, 0.5]
    assert fill_column(four, "three", "three", 0.5).schema == ScalarNAFiller(inputCol="three", outputCol="three", filler=0.5).transform(four).schema
    assert column(filler.transform(four, params={filler.filler: 40.0}), "filled")[0] == 40.0
    assert filler.getFiller() == 0.5
    assert column(filler.setFiller(6).transform(four), "filled")[3] == 6.0


def test_filler_defaults_to_zero_and_takes_several(four):
    filled = ScalarNAFiller(inputCols=["two", "three"], outputCols=["two", "three"]).transform(four)
    assert column(filled, "three") == [0.0, 21.0, 8.0, 0.0] and column(filled, "two") == [7.0, 9.0, 31.0, 5.0]


@pytest.mark.parametrize(
    "params",
    [{}, {"inputCol": "one", "inputCols": ["one"], "outputCol": "x"}, {"inputCols": ["one", "two"], "outputCols": ["x"]}, {"inputCol": "one"}],
)
def test_column_parameters_are_checked(four, params):
    with pytest.raises(ValueError):
        ScalarNAFiller(**params).transform(four)


def test_capper(four):
    model = ExtremeValueCapper(inputCol="two", outputCol="capped", boundary=1.0).fit(four)
    mean, deviation = four.agg(F.avg("two"), F.stddev("two")).head()
    assert model.getCap() == pytest.approx(mean + deviation) and model.getFloor() == pytest.approx(mean - deviation)
    assert model.getBoundary() == 1.0
    assert column(model.transform(four), "capped") == pytest.approx([7.0, 9.0, mean + deviation, 5.0])
    assert column(cap_column(four, "two", "capped", 1.0), "capped") == pytest.approx([7.0, 9.0, mean + deviation, 5.0])


def test_capper_keeps_nulls_and_takes_several_in_one_fit(four):
    model = ExtremeValueCapper(inputCols=["three", "four"], outputCols=["a", "b"], boundary=0.5).fit(four)
    assert len(model.getCap()) == 2
    capped = column(model.transform(four), "a")
    assert [capped[0], capped[3]] == [None, None] and None not in capped[1:3]


def test_capper_without_values_caps_nothing(four):
    empty = four.withColumn("none", F.lit(None).cast("double"))
    model = ExtremeValueCapper(inputCol="none", outputCol="out", boundary=2.0).fit(empty)
    assert column(model.transform(empty), "out") == [None] * 4


def test_setters_return_the_stage():
    capper = ExtremeValueCapper().setInputCol("a").setOutputCol("b").setBoundary(2)
    assert (capper.getInputCol(), capper.getOutputCol(), capper.getBoundary()) == ("a", "b", 2.0)
    model = ExtremeValueCapperModel(inputCol="a", outputCol="b", cap=3, floor=1).setCap(4).setFloor(0)
    assert (model.getCap(), model.getFloor()) == (4.0, 0.0)


def test_stages_load_in_another_process(spark, four):
    path = new_folder(spark, "stages")
    stages = Pipeline(
        stages=[ScalarNAFiller(inputCol="three", outputCol="f", filler=1.5), ExtremeValueCapper(inputCol="two", outputCol="c", boundary=1.0)]
    )
    fitted = stages.fit(four)
    fitted.write().overwrite().save(path)
    expected = [tuple(r) for r in fitted.transform(four).orderBy("one").collect()]
    assert [tuple(r) for r in PipelineModel.load(path).transform(four).orderBy("one").collect()] == expected
    script = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from tidemark.session import build_session\n"
        "from pyspark.ml import PipelineModel\n"
        "s = build_session('load', 'local[1]', **{'spark.ui.enabled': 'false'})\n"
        "print([type(x).__name__ for x in PipelineModel.load(sys.argv[2]).stages])\n"
    )
    repo = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", script, repo, path], capture_output=True, text=True, timeout=300)
    assert "['ScalarNAFiller', 'ExtremeValueCapperModel']" in out.stdout, out.stderr[-2000:]


def test_min_max_of_a_constant_is_half(four):
    scaled = P.min_max(four.withColumn("same", F.lit(7.0)), ["one", "same"], ["a", "b"])
    assert column(scaled, "a") == [0.0, 0.4, 1.0, 0.2] and column(scaled, "b") == [0.5] * 4


def test_assemble_leaves_out_incomplete_rows(four):
    assert P.assemble(four, ["one", "three"], "v").count() == 2


def test_ratios(spark):
    df = spark.createDataFrame([(2.0, 4.0), (2.0, 0.0), (None, 4.0)], "p double, w double")
    assert column(P.with_ratios(df, {"r": ("p", 4.0, "w")}), "r") == [2.0, 0.0, 0.0]
    assert column(P.with_ratios(df, {"r": ("p", 4.0, "w")}, filler=None), "r") == [2.0, None, None]


@pytest.fixture(scope="module")
def judged(spark):
    """A model on separable-with-noise data, and its predictions."""
    rows = [(float(i), float((i * 7) % 11), 1.0 if i + ((i * 5) % 13) > 60 else 0.0) for i in range(120)]
    df = spark.createDataFrame(rows, "x double, y double, label double")
    featured = P.assemble(df, ["x", "y"], "features")
    model = E.logistic("label").fit(featured)
    return model, featured, model.transform(featured).cache()


def test_area_equals_rank_formula(judged):
    _, _, predictions = judged
    scored = [(r.rawPrediction[1], r.label) for r in predictions.collect()]
    positive, negative = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    assert E.area_under_roc(predictions, "label") == pytest.approx(wins / len(positive) / len(negative), abs=1e-12)
    split = predictions.repartition(7)
    split.sparkSession.conf.set("spark.tidemark.window.maxGroupRows", "9")
    try:
        assert E.area_under_roc(split, "label") == pytest.approx(wins / len(positive) / len(negative), abs=1e-12)
        assert E.roc_points(split, "label").count() == len({s for s, _ in scored}) + 1
    finally:
        split.sparkSession.conf.unset("spark.tidemark.window.maxGroupRows")


def test_confusion_and_rates_agree(judged):
    model, featured, predictions = judged
    table = {r.label: (r["0.0"], r["1.0"]) for r in E.confusion(predictions, "label").collect()}
    assert sum(map(sum, table.values())) == 120
    summary = model.evaluate(featured)
    for row in E.precision_recall(predictions, "label").collect():
        at = int(row.label)
        assert row.precision == pytest.approx(summary.precisionByLabel[at])
        assert row.recall == pytest.approx(summary.recallByLabel[at])


def test_nothing_predicted_gives_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    assert [tuple(r) for r in E.precision_recall(df, "label").collect()] == [(0.0, 0.5, 1.0), (1.0, None, 0.0)]


def test_roc_runs_from_corner_to_corner(judged):
    _, _, predictions = judged
    points = sorted(tuple(r) for r in E.roc_points(predictions, "label").collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)


def test_grid_varies_the_model():
    stage = E.logistic("label")
    grid = E.penalty_grid(stage)
    assert len(grid) == 2 and all(point[stage.regParam] > 0 for point in grid)


def test_coefficients_come_with_names(spark, tables):
    rows, kept = R.featured(recipes(tables.customer, tables.orders))
    model, predictions = R.fitted(rows, R.model_stages(kept, maxIter=5))
    names = P.feature_names(predictions)
    assert names[: len(kept)] == kept and len(names) == len(kept) + 2 + 5
    table = E.coefficients(E.last_stage(model), names, spark).collect()
    assert len(table) == len(names) + 1 and [r.abs_coef for r in table] == sorted(abs(r.coef) for r in table)


def test_cleaned_rows(tables):
    raw = recipes(tables.customer, tables.orders)
    clean = R.cleaned(raw).cache()
    assert clean.where("dessert is null or cakeweek not in (0, 1) or wasteless not in (0, 1) or clove is null").isEmpty()
    assert dict(clean.dtypes)["rating"] == "double" and "quick_22_meals" in clean.columns
    assert 0 < clean.count() < raw.count()
    bounds = R.upper_bounds(clean, ["protein"])
    assert R.with_caps(clean, bounds).agg(F.max("protein")).head()[0] == pytest.approx(bounds["protein"])


def test_folds_do_not_depend_on_the_partitioning(spark):
    from tidemark.operators.rowsets import row_lot

    rows = spark.range(200).withColumn("fold", row_lot(["id"], 13, 3))
    assert sorted(rows.repartition(2).collect()) == sorted(rows.repartition(7).collect())
    assert {r.fold for r in rows.collect()} == {0, 1, 2}


def test_registered_measures_follow_from_the_predictions(spark, tables):
    """Rebuilt from the predictions one by one, beside the SQL texts."""
    from tidemark.registry.features import ml_auc, ml_confusion, ml_logistic, ml_precision_recall, ml_roc_points, model_and_predictions

    seen = [(r.dessert, r.prediction) for r in ml_logistic(tables).collect()]
    assert {r.dessert: (r["0.0"], r["1.0"]) for r in ml_confusion(tables).collect()} == {
        y: tuple(sum(s == (y, p) for s in seen) for p in (0.0, 1.0)) for y in {y for y, _ in seen}
    }
    for r in ml_precision_recall(tables).collect():
        hits, guessed, true = (sum(f(y, p) for y, p in seen) for f in (lambda y, p: y == p == r.label, lambda y, p: p == r.label, lambda y, p: y == r.label))
        assert (r.precision, r.recall) == (pytest.approx(hits / guessed) if guessed else None, pytest.approx(hits / true) if true else None)
    _, predictions = model_and_predictions(tables)
    scored = [(r.rawPrediction[1], r.dessert) for r in predictions.collect()]
    good, bad = [s for s, y in scored if y == 1], [s for s, y in scored if y == 0]
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    answer = ml_auc(tables).head()
    assert (answer.n, answer.area_under_roc) == (len(scored), pytest.approx(area, abs=1e-9))
    curve = {(sum(b >= s for b in bad) / len(bad), sum(g >= s for g in good) / len(good)) for s, _ in scored} | {(0.0, 0.0)}
    assert sorted(tuple(r) for r in ml_roc_points(tables).distinct().collect()) == [pytest.approx(x) for x in sorted(curve)]
