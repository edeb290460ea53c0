"""Evaluation of predicted classes, all derived from one count per (class, prediction) pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribado.functions.fixed import MAX_SCORE, MIN_SCORE
from cribado.functions.scores import int_score

CLASSES = range(MIN_SCORE, MAX_SCORE + 1)


def confusion_counts(df: DataFrame, y_col: str = "y", pred_col: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Rows per `(…by, y, pred)`: at most 36 rows per group."""
    pairs = df.select(*by, F.col(y_col).alias("y"), F.col(pred_col).alias("pred"))
    return pairs.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))


def confusion_pivot(confusion: DataFrame) -> DataFrame:
    """The counts as a matrix: a row per class, a column `pred_k` per prediction.

    A class that is only ever predicted has a row of zeros.
    """
    zero_row = F.struct(F.col("pred").alias("y"), "pred", F.lit(0).cast("bigint").alias("n"))
    confusion = confusion.select(F.inline(F.array(F.struct("y", "pred", "n"), zero_row)))
    cells = [
        F.coalesce(F.sum(F.when(F.col("pred") == k, F.col("n"))), F.lit(0)).alias(f"pred_{k}") for k in CLASSES
    ]
    return confusion.groupBy("y").agg(*cells).orderBy("y")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def class_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class that is a label or a prediction.

    A zero denominator gives 0.
    """
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    as_label = F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits"))
    as_pred = F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits"))
    sides = confusion.select(*by, F.inline(F.array(as_label, as_pred)))
    sums = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    return sums.select(
        *by,
        "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "hits",
    )


def classification_report(confusion: DataFrame) -> DataFrame:
    """One row per class, then `accuracy`, `macro avg` and `weighted avg`.

    Each line is a weighted mean of the class metrics, so one aggregation yields them all. The
    accuracy line has its value under `f1`, as in the printed report.
    """
    metrics = class_metrics(confusion)
    support = F.col("support").cast("double")
    lines = F.array(
        F.struct(F.col("label").cast("string").alias("line"), F.lit(1.0).alias("w")),
        F.struct(F.lit("macro avg").alias("line"), F.lit(1.0).alias("w")),
        F.struct(F.lit("weighted avg").alias("line"), support.alias("w")),
        F.struct(F.lit("accuracy").alias("line"), support.alias("w")),
    )
    weighted = metrics.select("*", F.inline(lines))
    is_accuracy = F.col("line") == "accuracy"
    means = {m: F.sum(F.col("w") * F.col(m)) / F.sum("w") for m in ("precision", "recall", "f1")}
    report = weighted.groupBy("line").agg(
        *[mean.alias(name) for name, mean in means.items()],
        (F.sum("hits") / F.sum("support")).alias("_accuracy"),
        F.sum("support").alias("support"),
    )
    return report.select(
        F.col("line").alias("label"),
        F.when(~is_accuracy, F.col("precision")).alias("precision"),
        F.when(~is_accuracy, F.col("recall")).alias("recall"),
        F.when(is_accuracy, F.col("_accuracy")).otherwise(F.col("f1")).alias("f1"),
        "support",
    )


def macro_metrics(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted class means of precision, recall and F1, and the accuracy."""
    return class_metrics(confusion, by).groupBy(*by).agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1_macro"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
    )


class MacroF1Evaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """Macro F1 of rounded regression output, for Spark ML's tuning tools."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        pairs = dataset.select(
            F.rint(self.getLabelCol()).cast("int").alias("y"), int_score(F.col(self.getPredictionCol())).alias("pred")
        )
        return macro_metrics(confusion_counts(pairs)).first().f1_macro

    def isLargerBetter(self) -> bool:
        return True
