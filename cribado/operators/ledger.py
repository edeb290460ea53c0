"""Model calls that survive a broken run: every answered batch is written down at once.

The ledger is a folder of small Parquet files `(key, response, error)`. A task writes one per batch, aside and then under
its name, so what is there is whole. A later run looks the keys up first and asks only for the others; another
attempt of a task takes up what the attempts before it have written. A ledger belongs to one model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cribado.functions.fixed import GENERATION_BATCH
from cribado.operators.generate import RESULT_SCHEMA, PredictorFactory, _predict
from cribado.session import materialize
from cribado.sources.files import replace, resolve

ENTRY = f"key string, {RESULT_SCHEMA}"


def key_of(*columns: str | Column) -> Column:
    """What a prompt is found by again: 128 bits over all its columns, so a changed row has another key."""
    return F.concat_ws("-", F.hex(F.xxhash64(*columns)), F.hex(F.xxhash64(F.lit("again"), *columns)))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """`(key, response, error)`, one row per key: an answer where there is one. Other files in the folder are not read."""
    filesystem, path = resolve(ledger)
    filesystem.create_dir(path)
    rows = spark.read.schema(ENTRY).option("pathGlobFilter", "*.parquet").parquet(ledger)
    best = F.min(F.struct(F.col("error").isNotNull(), "error", "response")).alias("best")
    return rows.groupBy("key").agg(best).select("key", "best.response", "best.error")


class _Notes:
    """The files of one partition of one run."""

    def __init__(self, ledger: str, run: str):
        self.filesystem, self.folder = resolve(ledger)
        context = TaskContext.get()
        self.prefix = f"{run}-{context.partitionId():06d}-"
        self.attempt, self.count = context.attemptNumber(), 0
        self.known: dict[str, tuple] = self._earlier() if self.attempt else {}

    def _earlier(self) -> dict[str, tuple]:
        import pyarrow.fs as pafs

        files = self.filesystem.get_file_info(pafs.FileSelector(self.folder))
        found = {}
        for info in files:
            if info.base_name.startswith(self.prefix):
                with self.filesystem.open_input_file(info.path) as source:
                    for row in pq.read_table(source).to_pylist():
                        found[row["key"]] = (row["response"], row["error"])
        return found

    def write(self, keys: list[str], results: list[tuple]) -> None:
        table = pa.table(
            {
                "key": pa.array(keys, pa.string()),
                "response": pa.array([r for r, _ in results], pa.string()),
                "error": pa.array([e for _, e in results], pa.string()),
            }
        )
        name = f"{self.prefix}{self.attempt:02d}-{self.count:06d}.parquet"
        with self.filesystem.open_output_stream(f"{self.folder}/.{name}") as out:
            pq.write_table(table, out)
        replace(self.filesystem, f"{self.folder}/.{name}", f"{self.folder}/{name}")
        self.count += 1


def generate_with_ledger(
    df: DataFrame,
    prompt_col: str,
    factory: PredictorFactory,
    ledger: str,
    keys: list[str],
    batch_size: int = GENERATION_BATCH,
    num_partitions: int | None = None,
    retry_errors: bool = True,
) -> DataFrame:
    """Add `response` and `error` to every row, and remember them in the folder `ledger`.

    One pass over the input. A row is known by the columns `keys` and its prompt: the same row is never asked twice,
    a changed one is asked anew, and equal rows share an answer once it is in the ledger. If a run breaks,
    at most the batch that each task was at is asked again. With `retry_errors`, rows whose model call failed are
    asked again by the next run. The result is stored before it is returned.
    """
    spark = df.sparkSession
    noted = read_ledger(spark, ledger)
    if retry_errors:
        noted = noted.filter("error IS NULL")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    keyed = df.select(row, F.col(prompt_col).alias("prompt"), key_of(*keys, prompt_col).alias("own_key"))
    known = F.col("key").isNotNull()
    rows = keyed.join(noted, keyed["own_key"] == noted["key"], "left")
    rows = rows.select("row", "own_key", known.alias("known"), "response", "error", F.when(~known, F.col("prompt")).alias("prompt"))
    rows = rows.repartition(num_partitions) if num_partitions else rows
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        predict, notes = factory(), _Notes(ledger, run_id)
        for prompts, own_keys, is_known in batches:
            results: list[tuple] = [(None, "no prompt")] * len(prompts)
            todo = []
            for i, (prompt, own, done) in enumerate(zip(prompts.tolist(), own_keys.tolist(), is_known.tolist())):
                if own in notes.known:
                    results[i] = notes.known[own]
                elif not done and prompt is not None:
                    todo.append((i, own, prompt))
            for start in range(0, len(todo), batch_size):
                part = todo[start : start + batch_size]
                answers = _predict(predict, [prompt for _, _, prompt in part])
                notes.write([own for _, own, _ in part], answers)
                for (i, _, _), answer in zip(part, answers):
                    results[i] = answer
            yield pd.DataFrame(results, columns=["response", "error"], dtype=object)

    # The annotations above are strings (PEP 563), so the kind of function is told explicitly.
    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    call = F.pandas_udf(run, RESULT_SCHEMA).asNondeterministic()
    answered = rows.withColumn("answer", call("prompt", "own_key", "known"))
    pick = lambda name: F.when(F.col("known"), F.col(name)).otherwise(F.col(f"answer.{name}")).alias(name)
    stored = materialize(answered.select("row", pick("response"), pick("error")))
    return stored.select("row.*", "response", "error")
