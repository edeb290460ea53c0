"""Stratified train/test split, exact and the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cribado.functions.fixed import MAX_SCORE, MIN_SCORE, SPLIT_SEED, TRAIN_PERMILLE

TRAIN = "train"
TEST = "test"

# 16**4 buckets per class: the one bucket that is sorted holds about 1/65536 of its class.
_BUCKET_DIGITS = 4


def _quotas(classes: DataFrame, y_col: str, train_permille: int) -> DataFrame:
    """Training rows per class by largest remainder, from the class counts `n` (at most six rows).

    Whole-number arithmetic; a class with a single row goes to training.
    """
    everything = Window.partitionBy(F.lit(0))
    n = F.col("n").cast("decimal(18,0)")
    total = classes.select(y_col, "n", F.sum("n").over(everything).alias("_all"))
    wanted = total.withColumn("_train", F.expr(f"(_all * {train_permille}) div 1000"))
    product = n * F.col("_train").cast("decimal(18,0)")
    whole = F.col("_all").cast("decimal(18,0)")
    shares = wanted.withColumn("_rest", product % whole)
    shares = shares.withColumn("_floor", ((product - F.col("_rest")) / whole).cast("bigint"))
    missing = F.col("_train") - F.sum("_floor").over(everything)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), y_col)
    extra = (F.row_number().over(order) <= missing).cast("bigint")
    quota = F.when(F.col("n") == 1, F.lit(1).cast("bigint")).otherwise(F.col("_floor") + extra)
    return shares.select(y_col, quota.alias("_quota"))


def stratified_split(
    df: DataFrame,
    id_col: str | Sequence[str],
    y_col: str = "y",
    train_permille: int = TRAIN_PERMILLE,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Add `split`: the rows of each class with the smallest hashed ids go to training.

    A plain ranking would sort each class in one task. Instead, counts per hash prefix find the
    prefix in which a class reaches its quota; only the rows with that prefix are sorted, and
    give the last hash that is still training. The rows themselves are then marked by comparing
    hashes, without a shuffle. An id may be several columns together, as `(dataset, id)`; rows that
    share one are an error, as no split could tell them apart. Classes are the six of the scale; a
    row without a class gets no split. Ids and classes are read several times, so store them first
    if they are costly to compute.
    """
    columns = [id_col] if isinstance(id_col, str) else list(id_col)
    hashed = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))))
    in_class = F.col(y_col).between(MIN_SCORE, MAX_SCORE)
    keys = df.filter(in_class).select(y_col, hashed.alias("_hash"))
    keys = keys.withColumn("_bucket", F.left("_hash", F.lit(_BUCKET_DIGITS)))

    if not keys.groupBy("_hash").count().filter("count > 1").isEmpty():
        raise ValueError(f"ids in {columns} are repeated")

    counts = keys.groupBy(y_col, "_bucket").agg(F.count("*").alias("n"))
    # Broadcasts here hold one row per class of the scale: six rows at most.
    quotas = F.broadcast(_quotas(counts.groupBy(y_col).agg(F.sum("n").alias("n")), y_col, train_permille))
    upto = F.sum("n").over(Window.partitionBy(y_col).orderBy("_bucket"))
    edges = (
        counts.withColumn("_upto", upto)
        .join(quotas, y_col)
        .filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("n") < F.col("_quota")))
        .select(y_col, "_bucket", (F.col("_quota") - F.col("_upto") + F.col("n")).alias("_need"))
    )
    place = F.row_number().over(Window.partitionBy(y_col).orderBy("_hash"))
    cuts = (
        keys.join(F.broadcast(edges), [y_col, "_bucket"])
        .withColumn("_place", place)
        .filter(F.col("_place") == F.col("_need"))
        .select(F.col(y_col).alias("_class"), F.col("_hash").alias("_last"))
    )
    marked = df.withColumn("_hash", hashed).join(F.broadcast(cuts), F.col(y_col) == F.col("_class"), "left")
    split = F.when(F.col("_hash") <= F.col("_last"), TRAIN).when(in_class, TEST)
    return marked.withColumn("split", split).select(*df.columns, "split")
