"""Control over where the optimizer evaluates an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_column_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    A filter on a plain column moves below the projection and repeats the column's expression
    there, once per mention. It cannot move below a generator, so the value passes through an
    array of one element. Still one stage, without a shuffle.
    """
    others = [column for column in df.columns if column != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))
