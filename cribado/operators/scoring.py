"""Scoring: a map over the rows, without a shuffle."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.functions.plan import with_column_once
from cribado.functions.scores import int_score


def quantize(df: DataFrame, score_col: str = "score") -> DataFrame:
    """Add `int_score`; `score` itself stays unclamped."""
    return df.withColumn("int_score", int_score(F.col(score_col)))


def score_documents(model: Model, df: DataFrame) -> DataFrame:
    """All input columns plus `score` and `int_score`. Also runs on a streaming DataFrame.

    The model runs once per row, also when the result is filtered by score.
    """
    scored = with_column_once(model.transform(df), "score", F.col("prediction"))
    return quantize(scored.select(*df.columns, "score"))
