"""Label counts that grow with the shards, without counting the old ones again.

The stream keeps one number pair per (dataset, kind, tag) as its state: occurrences and the first place. After each batch
of files the tags that changed are written under the batch's number; a batch that is repeated after a failure writes the
same under the same number. The latest entry of each tag is its count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribado.operators.labels import FIRST_COUNTS, first_counts, grouped_counts, placed_tags

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def count_new_labels(
    spark: SparkSession,
    input_dir: str,
    schema: T.StructType,
    normalize: Callable[[DataFrame], DataFrame],
    counts_dir: str,
    checkpoint_dir: str,
    id_col: str = "id",
    path_col: str = "dataset",
    pattern: str = "*.parquet",
    max_files_per_batch: int = 10_000,
    drop_cut_tag: bool = True,
) -> None:
    """Add the labels of the files that are new since the last run, then return.

    `normalize` turns the files' rows into normalized labels with `dataset` and `id_col`. All three folders have to be on
    shared storage. State lies on the executors' disks and in the checkpoint, so millions of made-up tags do no harm.
    """
    spark.conf.set(STATE_STORE, ON_DISK)
    files = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files_per_batch)
    counts = first_counts(placed_tags(normalize(files.parquet(input_dir)), id_col, path_col, drop_cut_tag))

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{counts_dir}/batch={batch}")

    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_counts(spark: SparkSession, counts_dir: str, per_dataset: bool = True, combined: bool = True) -> DataFrame:
    """The counts so far, as `labels.tag_counts` gives them for all shards at once."""
    schema = T.StructType([*T.StructType.fromDDL(FIRST_COUNTS).fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(counts_dir)
    latest = rows.groupBy("dataset", "in_all", "kind", "tag").agg(F.max("batch").alias("batch"))
    keys = ["dataset", "in_all", "kind", "tag", "batch"]
    renamed = latest.select(*(F.col(c).alias(f"last_{c}") for c in keys))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"last_{c}"))
    return grouped_counts(rows.join(renamed, same, "left_semi").drop("batch"), per_dataset, combined)
