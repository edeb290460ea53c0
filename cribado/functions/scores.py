"""Score arithmetic."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cribado.functions.fixed import MAX_SCORE, MIN_SCORE


def _decimal_digits() -> tuple[str, str]:
    """All decimal digits but 0-9, and the 0-9 each stands for."""
    others = [chr(c) for c in range(0x80, 0x20000) if chr(c).isdecimal()]
    return "".join(others), "".join(str(unicodedata.decimal(c)) for c in others)


_DIGITS = _decimal_digits()


def rating_class(raw: Column) -> Column:
    """Truncate a raw rating at its dot and clip it to the scale; NULL when it has no digits.

    The NULL guard is needed because `greatest` and `least` skip NULLs.
    """
    value = F.regexp_replace(F.translate(raw, *_DIGITS), r"\..*", "").try_cast("double")
    clipped = F.least(F.greatest(value, F.lit(float(MIN_SCORE))), F.lit(float(MAX_SCORE)))
    return F.when(value.isNotNull(), clipped.cast("int"))


def int_score(score: Column) -> Column:
    """Clamp to the scale and round half to even (`round` is half up); NaN gives 0."""
    clamped = F.least(F.greatest(score, F.lit(float(MIN_SCORE))), F.lit(float(MAX_SCORE)))
    rounded = F.when(F.isnan(score), F.lit(0.0)).otherwise(F.rint(clamped))
    return F.when(score.isNotNull(), rounded.cast("int"))


def linear_score(features: Column, weights: Sequence[float], intercept: float = 0.0) -> Column:
    """Dot product of an array column with fixed weights; an array of another length is an error, NULL stays NULL."""
    weight_array = F.array(*[F.lit(float(w)) for w in weights])
    products = F.zip_with(features, weight_array, lambda x, w: x.cast("double") * w)
    score = F.aggregate(products, F.lit(float(intercept)), lambda acc, x: acc + x)
    fits = features.isNull() | (F.size(features) == len(weights))
    return F.when(fits, score).otherwise(F.raise_error(F.lit(f"features of another length than {len(weights)}")))
