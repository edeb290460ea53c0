"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what counts as a word, for Java, Python and DuckDB alike.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; NULL and texts without words give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words, without keeping them: pieces less the empty ones at either end."""
    filled = F.coalesce(text, F.lit(""))
    gap_first = filled.rlike(r"\A[\x20\x09-\x0D]").cast("long")
    gap_last = filled.rlike(r"[\x20\x09-\x0D]\z").cast("long")
    count = F.size(F.split(filled, WORD_GAP)) - gap_first - gap_last
    return F.when(filled.rlike(r"[^\x20\x09-\x0D]"), count).otherwise(F.lit(0)).cast("long")


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
