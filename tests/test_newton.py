"""Newton fits on weighted cells against the built-in classifier and against fits of the rows themselves."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidemark.features import evaluate as E
from tidemark.features import newton as N

NAMES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        a, b = rng.gauss(0, 3), float(rng.randrange(3))
        c = None if i % 9 == 0 else rng.random() * 1000
        y = float(rng.random() < 1 / (1 + np.exp(-(a * 0.5 - b + (c or 500) / 400 - 1))))
        data += [(y, a, b, c, 7.0, i % 3)] * rng.choice([1, 1, 4])
    return spark.createDataFrame(data, "y double, a double, b double, c double, flat double, f int").repartition(3).cache()


@pytest.mark.parametrize("strength, mix", [(0.0, 0.0), (0.02, 0.0), (0.02, 1.0), (0.02, 0.4)])
def test_like_the_built_in_model(points, strength, mix):
    fit = N.fitted(N.weighted_cells(points, "y", NAMES), NAMES, [N.Wanted(strength, mix)])[0]
    mean = points.agg(F.avg("c")).head()[0]
    filled = VectorAssembler(inputCols=NAMES, outputCol="features").transform(points.fillna(mean, subset=["c"]))
    model = E.logistic("y", regParam=strength, elasticNetParam=mix, tol=1e-13, maxIter=500).fit(filled)
    assert (fit.intercept, *fit.weights) == pytest.approx((model.intercept, *model.coefficients), abs=2e-5)
    assert fit.weights[3] == 0 and fit.means[2] == pytest.approx(mean)
    seen = N.predicted(points, fit).select("prediction", "rawPrediction", fit.score().alias("s")).collect()
    assert all((r.prediction == 1) == (r.s > 0) and r.rawPrediction[1] == r.s for r in seen)


def test_folds_left_out_equal_fits_of_the_other_rows(points):
    cells = N.weighted_cells(points, "y", NAMES, F.col("f"))
    wanted = [N.Wanted(s, m, f) for f in (None, 0, 1, 2) for s, m in ((0.0, 0.0), (0.05, 1.0))]
    fits = N.fitted(cells, NAMES, wanted)
    for w, fit in zip(wanted, fits):
        rows = points if w.left_out is None else points.where(F.col("f") != w.left_out)
        alone = N.fitted(N.weighted_cells(rows, "y", NAMES), NAMES, [N.Wanted(w.strength, w.mix)])[0]
        assert (fit.intercept, *fit.weights, *fit.means) == pytest.approx((alone.intercept, *alone.weights, *alone.means), abs=1e-8)
    assert cells.agg(F.sum("n")).head()[0] == points.count() > cells.count()


def test_areas_per_key(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(6) / 2, float(rng.random() < 0.4), rng.randint(1, 3)) for k in "xy" for _ in range(60)] + [("one", 0.5, 1.0, 2)]
    got = {r.k: r.area_under_roc for r in E.areas_under_roc(spark.createDataFrame(rows, "k string, score double, label double, n long"), ["k"]).collect()}
    for k in "xy":
        good, bad = ([s for q, s, y, n in rows if q == k and y == v for _ in range(n)] for v in (1.0, 0.0))
        assert got[k] == pytest.approx(sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad), abs=1e-12)
    assert got["one"] is None


def test_nothing_to_learn_from(points):
    none = N.weighted_cells(points.where("false"), "y", NAMES)
    with pytest.raises(ValueError):
        N.fitted(none, NAMES, [N.Wanted()])
    one_fold = N.weighted_cells(points.where("f = 1"), "y", NAMES, F.col("f"))
    with pytest.raises(ValueError):
        N.fitted(one_fold, NAMES, [N.Wanted(left_out=1)])
