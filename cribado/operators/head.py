"""The scoring head: linear least squares on frozen features, chosen on a held-out split."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cribado.functions.scores import int_score
from cribado.operators.evaluation import confusion_counts, macro_metrics
from cribado.operators.features import FEATURES, apply_stages


@dataclass(frozen=True)
class Candidate:
    """Settings of one head. A fit that needs iterations ends after `max_iter` or within `tolerance`."""

    reg_param: float = 0.0
    elastic_net: float = 0.0
    max_iter: int = 100
    tolerance: float = 1e-6


@dataclass(frozen=True)
class Selection:
    """The best model and the held-out metrics of all candidates, in grid order."""

    model: PipelineModel
    leaderboard: list[dict]


DEFAULT_GRID = (Candidate(0.1), Candidate(1.0), Candidate(10.0))


def head(candidate: Candidate, label_col: str = "label") -> LinearRegression:
    """One real output per row, squared error."""
    return LinearRegression(
        featuresCol=FEATURES,
        labelCol=label_col,
        regParam=candidate.reg_param,
        elasticNetParam=candidate.elastic_net,
        maxIter=candidate.max_iter,
        tol=candidate.tolerance,
    )


def fit_head(train: DataFrame, candidate: Candidate = Candidate(), label_col: str = "label") -> LinearRegressionModel:
    """Fit on rows that already have features; warns if the iterations end before the tolerance is met."""
    model = head(candidate, label_col).fit(train)
    if model.hasSummary and model.summary.totalIterations >= candidate.max_iter:
        warnings.warn(f"not converged after {candidate.max_iter} iterations: {candidate}", RuntimeWarning, stacklevel=2)
    return model


def fit_stages(stages: Sequence[Estimator | Transformer], train: DataFrame) -> tuple[list[Transformer], DataFrame, list[DataFrame]]:
    """Fit stages in turn: the fitted ones, the transformed rows, and what is stored meanwhile.

    Rows are stored before a stage that has to be fitted, so what comes before it (here splitting and
    hashing the texts) runs once, not once per pass.
    """
    fitted, stored = [], []
    for stage in stages:
        if isinstance(stage, Estimator):
            train = train.persist(StorageLevel.MEMORY_AND_DISK)
            stored.append(train)
            stage = stage.fit(train)
        fitted.append(stage)
        train = stage.transform(train)
    return fitted, train, stored


def select_head(
    train: DataFrame,
    test: DataFrame,
    feature_stages: Sequence[Estimator] = (),
    grid: Sequence[Candidate] = DEFAULT_GRID,
    label_col: str = "label",
) -> Selection:
    """Fit every candidate on `train`, keep the one with the best macro F1 on `test`.

    Feature stages are fitted on `train` alone and once. The features of `train` are cached for
    the fits; `test` is read once, for all candidates together. What reaches the driver is one
    row of metrics per candidate. The first of equal candidates wins.
    """
    stages, prepared, stored = fit_stages(feature_stages, train)
    prepared = prepared.select(label_col, FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = [fit_head(prepared, candidate, label_col) for candidate in grid]
    finally:
        for rows in (prepared, *stored):
            rows.unpersist()

    scored = apply_stages(stages, test).select(label_col, FEATURES)
    for index, model in enumerate(models):
        scored = model.copy({model.predictionCol: f"_p{index}"}).transform(scored)
    predictions = F.array(*[int_score(F.col(f"_p{index}")) for index in range(len(models))])
    pairs = scored.select(F.rint(label_col).cast("int").alias("y"), F.posexplode(predictions).alias("candidate", "pred"))
    metrics = {
        row.candidate: row
        for row in macro_metrics(confusion_counts(pairs, by=["candidate"]), by=["candidate"]).collect()
    }
    if len(metrics) < len(models):
        raise ValueError("the held-out split is empty")
    # Rounded, as the order in which class means are added up may change their last digit.
    best = max(range(len(models)), key=lambda index: (round(metrics[index].f1_macro, 12), -index))
    leaderboard = [
        {
            "candidate": index,
            "reg_param": float(candidate.reg_param),
            "elastic_net": float(candidate.elastic_net),
            "max_iter": candidate.max_iter,
            **{name: metrics[index][name] for name in ("precision", "recall", "f1_macro", "accuracy")},
            "best": index == best,
        }
        for index, candidate in enumerate(grid)
    ]
    return Selection(PipelineModel(stages=[*stages, models[best]]), leaderboard)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
