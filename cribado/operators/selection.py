"""Keeping the documents at or above a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_by_score(df: DataFrame, threshold: int) -> DataFrame:
    """Rows with `int_score >= threshold`; reaches the scan as a partition or Parquet filter."""
    return df.filter(F.col("int_score") >= threshold)


def filter_counts(df: DataFrame, threshold: int) -> DataFrame:
    """Rows before and after the filter, in one pass."""
    return df.agg(F.count("*").alias("n_before"), F.count_if(F.col("int_score") >= threshold).alias("n_after"))
