"""From responses to training ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.functions.plan import with_column_once
from cribado.functions.responses import rating_text
from cribado.functions.scores import rating_class


def parse_ratings(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Replace the response by `score_raw`; rows without a rating drop out."""
    parsed = with_column_once(df, "score_raw", rating_text(F.col(response_col)))
    return parsed.filter(F.col("score_raw").isNotNull()).drop(response_col)


def clean_ratings(df: DataFrame) -> DataFrame:
    """Add the class `y` (0 to 5). A rating without digits before its dot has `y` NULL."""
    return with_column_once(df, "y", rating_class(F.col("score_raw")))


def training_rows(cleaned: DataFrame) -> DataFrame:
    """Rows with a class, and the class as regression label."""
    return cleaned.filter(F.col("y").isNotNull()).withColumn("label", F.col("y").cast("double"))


def join_responses(docs: DataFrame, responses: DataFrame, id_col: str) -> DataFrame:
    """Documents with their separately stored responses; documents without one drop out.

    No broadcast hint: both sides grow with the corpus, and the optimizer broadcasts the
    responses by itself where their size allows it.
    """
    return docs.join(responses, id_col, "inner")


def run_summary(df: DataFrame, dataset_col: str, response_col: str = "response", error_col: str = "error") -> DataFrame:
    """Rows, responses, errors, parsed, accepted and rejected ratings per dataset."""
    raw = df.select(
        dataset_col,
        F.col(response_col).isNotNull().alias("_answered"),
        F.col(error_col).isNotNull().alias("_failed"),
        rating_text(F.col(response_col)).alias("score_raw"),
    )
    parsed = F.col("score_raw").isNotNull()
    return (
        clean_ratings(raw)
        .groupBy(dataset_col)
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if("_answered").alias("n_responses"),
            F.count_if("_failed").alias("n_errors"),
            F.count_if(parsed).alias("n_parsed"),
            F.count("y").alias("n_accepted"),
            F.count_if(parsed & F.col("y").isNull()).alias("n_rejected"),
        )
    )
