from __future__ import annotations

import random

import pytest

from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

from cribado.operators import evaluation

PAIRS = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2), (3, 2)]


def confusion(spark, pairs):
    return evaluation.confusion_counts(spark.createDataFrame(pairs, "y int, pred int"))


def by_hand(pairs):
    classes = sorted({c for pair in pairs for c in pair})
    rows = {}
    for c in classes:
        hits = sum(y == p == c for y, p in pairs)
        predicted, support = sum(p == c for _, p in pairs), sum(y == c for y, _ in pairs)
        precision = hits / predicted if predicted else 0.0
        recall = hits / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        rows[str(c)] = (precision, recall, f1, support)
    return rows


def test_macro_metrics(spark):
    row = evaluation.macro_metrics(confusion(spark, PAIRS)).first()
    assert (round(row.precision, 6), round(row.recall, 6), round(row.f1_macro, 6)) == (0.5, 0.541667, 0.458333)
    assert row.accuracy == pytest.approx(4 / 7)


def test_report_against_counting_by_hand(spark):
    rng = random.Random(1)
    for pairs in (PAIRS, [(rng.choice([0, 1, 5]), rng.randrange(6)) for _ in range(200)]):
        report = {r.label: r for r in evaluation.classification_report(confusion(spark, pairs)).collect()}
        rows = by_hand(pairs)
        assert set(report) == set(rows) | {"accuracy", "macro avg", "weighted avg"}
        for label, values in rows.items():
            r = report[label]
            assert (r.precision, r.recall, r.f1, r.support) == pytest.approx(values)
        n = len(pairs)
        for position, name in enumerate(("precision", "recall", "f1")):
            assert report["macro avg"][name] == pytest.approx(sum(v[position] for v in rows.values()) / len(rows))
            weighted = sum(v[position] * v[3] for v in rows.values()) / n
            assert report["weighted avg"][name] == pytest.approx(weighted)
        accuracy = report["accuracy"]
        assert accuracy.f1 == pytest.approx(sum(y == p for y, p in pairs) / n)
        assert accuracy.precision is None and accuracy.support == n


def test_pivot(spark):
    rows = evaluation.confusion_pivot(confusion(spark, PAIRS)).collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1, 0, 0, 0, 0), (1, 0, 1, 0, 0, 0, 0), (2, 0, 1, 2, 0, 0, 0), (3, 0, 0, 1, 0, 0, 0)]
    rows = evaluation.confusion_pivot(confusion(spark, [(0, 2)])).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, 1, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0)]


def test_evaluator_rounds_and_clamps(spark):
    rows = [(0.0, -3.0), (0.0, 0.6), (1.0, 1.4), (2.0, 0.51), (2.0, 2.5), (2.0, 1.7), (3.0, 2.2)]
    evaluator = evaluation.MacroF1Evaluator()
    assert evaluator.evaluate(spark.createDataFrame(rows, "label double, prediction double")) == pytest.approx(0.458333, abs=1e-6)
    assert evaluator.isLargerBetter()


def test_evaluator_drives_spark_tuning(spark):
    rows = [(Vectors.dense([float(i % 6)]), float(i % 6)) for i in range(200)]
    df = spark.createDataFrame(rows, ["features", "label"])
    regression = LinearRegression()
    grid = ParamGridBuilder().addGrid(regression.regParam, [100.0, 0.0]).build()
    tuned = TrainValidationSplit(
        estimator=regression, estimatorParamMaps=grid, evaluator=evaluation.MacroF1Evaluator(), seed=1
    ).fit(df)
    assert tuned.validationMetrics[1] == 1.0 > tuned.validationMetrics[0]
    assert tuned.bestModel.getRegParam() == 0.0
