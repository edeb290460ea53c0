"""Readers. Parquet is the native format; the others import what other tools have written."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cribado.functions.fixed import RESULT_GLOB
from cribado.functions.text import dataset_of_result, dataset_of_shard
from cribado.sources.arrow_ipc import LOG, ArrowShards
from cribado.sources.json_results import SPLIT_BYTES, read_records

RATING_RECORD = T.StructType([T.StructField("Score", T.StringType()), T.StructField("Prompt", T.StringType())])
LABEL_RECORD = T.StructType([T.StructField("domains", T.StringType()), T.StructField("use_cases", T.StringType())])


def read_shards(spark: SparkSession, *paths: str, pattern: str = "*.parquet") -> DataFrame:
    """All Parquet shards of the folders as one table; `pattern` is held against names of files, not of folders."""
    return spark.read.option("pathGlobFilter", pattern).parquet(*paths)


def with_provenance(df: DataFrame) -> DataFrame:
    """Add path and name of the Parquet file each row came from, and the row's position in it."""
    fields = [F.col(f"_metadata.{name}").alias(name) for name in ("file_path", "file_name", "row_index")]
    return df.select("*", *fields)


def with_shard_provenance(rows: DataFrame, shard: Column) -> DataFrame:
    """Rows `with_provenance` by shards, each one file or a folder of part files: `file_name` becomes the name `shard`, an
    expression of `file_path`, and `row_index` the row's position in the shard, whose parts follow each other by path.

    Part files are counted by their footers; their counts, a row per file, are broadcast.
    """
    parts = rows.groupBy("file_path").agg(F.count("*").alias("part_rows"))
    parts = parts.select(F.col("file_path").alias("part_path"), shard.alias("part_shard"), "part_rows")
    earlier = Window.partitionBy("part_shard").orderBy("part_path").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)))
    placed = rows.join(F.broadcast(parts), F.col("file_path") == F.col("part_path"))
    placed = placed.withColumns({"file_name": F.col("part_shard"), "row_index": F.col("row_index") + F.col("part_start")})
    return placed.drop(*parts.columns)


def _holds(column: str, operator: str, value) -> Column:
    c = F.col(column)
    compared = {"=": c.__eq__, "<": c.__lt__, "<=": c.__le__, ">": c.__gt__, ">=": c.__ge__, "in": c.isin}
    return {"null": c.isNull, "not null": c.isNotNull}[operator]() if operator not in compared else compared[operator](value)


def read_arrow(
    spark: SparkSession, paths: str | list[str], where: Sequence[tuple[str, str, object]] = (), **options: str
) -> DataFrame:
    """Arrow IPC shards, or the rows for which all conditions `(column, operator, value)` hold; see `arrow_ipc`.

    Batches whose noted values rule a match out are not read.
    """
    spark.dataSource.register(ArrowShards)
    rows = spark.read.format("arrow_ipc").options(where=json.dumps(list(where)), **options).load(paths)
    for condition in where:
        rows = rows.filter(_holds(*condition))
    return rows


def read_datasets(spark: SparkSession, manifest: str, **options: str) -> DataFrame:
    """All Arrow shards a manifest lists as one table, with `dataset`, `shard_path` and `row_index`."""
    rows = read_arrow(spark, manifest_paths(spark, manifest), provenance="true", **options)
    return rows.withColumn("dataset", dataset_of_shard(F.col("shard_path")))


def list_shards(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """`(path, length, modified)` of the files in a folder, with the second of the last change; no file is opened."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", F.unix_seconds("modificationTime").alias("modified"))


def read_commits(spark: SparkSession, folder: str) -> DataFrame:
    """The log of the shards `sinks.write_shards` has completed there: `(name, length, modified, n_rows)`."""
    return spark.read.schema("name string, length long, modified long, n_rows long").json(f"{folder}/{LOG}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Dataset paths of a manifest: one per line, blank and `#` lines left out."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("path"))
    return lines.filter((F.col("path") != "") & ~F.col("path").startswith("#"))


def manifest_paths(spark: SparkSession, path: str) -> list[str]:
    """The manifest as a list to hand to a reader; an empty one is an error."""
    paths = [row.path for row in read_manifest(spark, path).collect()]
    if not paths:
        raise ValueError(f"no datasets in {path}")
    return paths


def read_template(spark: SparkSession, path: str) -> str:
    """A prompt template: one small UTF-8 text file."""
    return spark.read.text(path, wholetext=True).first().value


def read_results(
    spark: SparkSession, path: str, record: T.StructType, pattern: str = "*.json", split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Results files, each one JSON object `{index: record}`, as rows `(path, id, …record)`.

    Files of any layout, on one line too, are read in ranges of `split_bytes`. A file that was cut off or does not parse is
    an error.
    """
    records = read_records(spark, list_shards(spark, path, pattern, recursive=True), split_bytes)
    parsed = F.from_json("record", record, {"mode": "FAILFAST"})
    return records.select("path", F.col("key").cast("bigint").alias("id"), parsed.alias("record")).select("path", "id", "record.*")


def read_ratings(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Rating results as `(path, id, score_raw, text)`."""
    rows = read_results(spark, path, RATING_RECORD, **options)
    return rows.select("path", "id", F.col("Score").alias("score_raw"), F.col("Prompt").alias("text"))


def read_labels(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Label results found anywhere below `path` as `(path, dataset, id, domains, use_cases)`."""
    rows = read_results(spark, path, LABEL_RECORD, RESULT_GLOB, **options)
    return rows.select("path", dataset_of_result(F.col("path")).alias("dataset"), "id", "domains", "use_cases")


def union_shards(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all shards, duplicates included, columns matched by name.

    For a few tables of different origin; shards of one layout are read together by their paths.
    """
    union = first
    for other in others:
        union = union.unionByName(other)
    return union
