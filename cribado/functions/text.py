"""Prompt rendering, token budgets and dataset names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cribado.functions.fixed import PLACEHOLDER, PROMPT_TOKENS, RESULT_PREFIX, SPACE_CHARS


def render_prompt(template: str, text: Column) -> Column:
    """Literal replacement of every placeholder; NULL text gives a NULL prompt."""
    return F.replace(F.lit(template), F.lit(PLACEHOLDER), text)


def strip(value: Column) -> Column:
    """Remove Unicode whitespace at both ends (`trim` alone removes blanks only)."""
    return F.btrim(value, F.lit(SPACE_CHARS))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens. Same class as in `fixed`, in the form the JVM tests fastest."""
    return F.split(strip(text), r"(?U)[\s\x1c-\x1f]+")


def token_budget(text: Column, limit: int = PROMPT_TOKENS, keep: str = "last") -> Column:
    """Keep the first or last `limit` tokens; text within the budget stays as it is.

    Prompts keep their end, encoder inputs their start. The budget counts whitespace tokens;
    exact subword counts belong to the plugged-in model's own tokenizer.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    parts = tokens(text)
    kept = F.slice(parts, 1 if keep == "first" else -limit, limit)
    return F.when(F.size(parts) <= limit, text).otherwise(F.array_join(kept, " "))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dataset_of_shard(path: Column) -> Column:
    """Name of the shard's parent folder, `_` written as `-`; NULL without a parent."""
    return F.translate(F.try_element_at(F.split(path, "/"), F.lit(-2)), "_", "-")


def result_file(shard_path: Column, model_path: Column) -> Column:
    """File name under which the labels of a shard are stored."""
    return F.concat(
        F.lit(RESULT_PREFIX + "_"), dataset_of_shard(shard_path), F.lit("_"), file_name(model_path), F.lit(".json")
    )


def dataset_of_result(path: Column) -> Column:
    """Dataset part of a result file name; NULL when the name has none."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    return F.get(F.split(stem, "_"), F.lit(1))
