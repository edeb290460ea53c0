"""Process only the files that are new since the last run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def process_new_files(
    spark: SparkSession,
    input_dir: str,
    schema: T.StructType,
    process: Callable[[DataFrame], DataFrame],
    output_dir: str,
    checkpoint_dir: str,
    pattern: str = "*.parquet",
    partition_by: Sequence[str] = (),
    max_files_per_batch: int = 10_000,
) -> None:
    """Apply `process` (row-wise, e.g. scoring) to new files and append to `output_dir`.

    Runs until the files present at the start are done, then returns. The checkpoint remembers
    finished files and the sink commits whole batches, so a rerun adds nothing and a broken run
    resumes without repeating or losing rows. Both folders have to be on shared storage.
    """
    source = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .parquet(input_dir)
    )
    writer = process(source).writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = (
        writer.option("path", output_dir)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
