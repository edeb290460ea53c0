"""Features for the scoring head. The encoder is frozen: features are computed, never trained."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.base import Transformer
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribado.functions.fixed import SCORING_BATCH

FEATURES = "features"
NUM_FEATURES = 1 << 14


def text_stages(text_col: str, num_features: int = NUM_FEATURES, min_doc_freq: int = 1) -> list:
    """Hashed TF-IDF of the whole text, scaled to unit length: no external model, no Python.

    `num_features` fixes the memory of model and fit, and how often different words share a place. Up
    to 4096 one pass over the data gives the exact least-squares solution; above, the fit passes over
    the stored features once per iteration.
    """
    words = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=num_features)
    weights = IDF(inputCol="_counts", outputCol="_weights", minDocFreq=min_doc_freq)
    return [words, counts, weights, Normalizer(inputCol="_weights", outputCol=FEATURES)]


def vector_features(df: DataFrame, array_col: str) -> DataFrame:
    """Features from an existing embedding column."""
    return df.withColumn(FEATURES, array_to_vector(F.col(array_col)))


def encoder_features(
    df: DataFrame, text_col: str, make_predict_fn: Callable[[], Callable], batch_size: int = SCORING_BATCH
) -> DataFrame:
    """Features from the caller's encoder.

    `make_predict_fn` runs once per Python worker and returns a function from an array of texts
    to a matrix with one row per text.
    """
    encode = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(FEATURES, array_to_vector(encode(F.col(text_col))))


def apply_stages(stages: list[Transformer], df: DataFrame) -> DataFrame:
    """Run fitted stages one after the other."""
    for stage in stages:
        df = stage.transform(df)
    return df
