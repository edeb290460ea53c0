"""Batched text generation with a model the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.functions.fixed import GENERATION_BATCH

Predictor = Callable[[list[str]], list[str]]
PredictorFactory = Callable[[], Predictor]

RESULT_SCHEMA = "response string, error string"


def _predict(predict: Predictor, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """One call for the batch; if it fails, one call per prompt to find the failing ones."""
    try:
        responses = predict(prompts)
    except Exception as error:  # noqa: BLE001 - any model error becomes a row error
        if len(prompts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        return [_predict(predict, [prompt])[0] for prompt in prompts]
    if len(responses) != len(prompts):
        raise ValueError(f"{len(responses)} responses for {len(prompts)} prompts")
    return [(response, None) for response in responses]


def generate(
    df: DataFrame,
    prompt_col: str,
    factory: PredictorFactory,
    batch_size: int = GENERATION_BATCH,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add `response` and `error` to every row.

    `factory` runs once per task and returns the predictor. Only the prompt column crosses to
    Python; the other columns wait in the JVM. The function is marked non-deterministic so that
    the optimizer neither moves nor repeats it. Store the result before parsing it (`materialize`):
    then each prompt costs one model call. `num_partitions` shuffles the rows over that many
    tasks, for as many tasks as there are models to serve them.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = factory()
        for batch in batches:
            prompts = batch.tolist()
            known = [i for i, prompt in enumerate(prompts) if prompt is not None]
            results: list[tuple[str | None, str | None]] = [(None, "no prompt")] * len(prompts)
            for start in range(0, len(known), batch_size):
                rows = known[start : start + batch_size]
                for i, result in zip(rows, _predict(predict, [prompts[i] for i in rows])):
                    results[i] = result
            yield pd.DataFrame(results, columns=["response", "error"], dtype=object)

    # The annotations above are strings (PEP 563), so the kind of function is told explicitly.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    call = F.pandas_udf(run, RESULT_SCHEMA).asNondeterministic()
    spread = df.repartition(num_partitions) if num_partitions else df
    answered = spread.withColumn("_answer", call(F.col(prompt_col)))
    return answered.select(*df.columns, "_answer.response", "_answer.error")
