"""Drawing the documents to rate: the same number from every dataset, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# 16**4 parts per dataset: only the part in which a dataset's number is reached is sorted.
_PREFIX_DIGITS = 4


def sample_for_rating(df: DataFrame, id_col: str, dataset_col: str, n: int, seed: int = 42) -> DataFrame:
    """Of every dataset the `n` rows with the smallest hashed ids, or all if it has fewer.

    Counts per hash prefix find the prefix in which a dataset reaches `n`; rows with a smaller prefix are taken, and
    only those with that prefix are ranked. So no dataset is sorted in one task. Ids are unique in a
    dataset; a NULL dataset is one of its own.
    """
    hashed = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    keyed = df.withColumn("_hash", hashed).withColumn("_prefix", F.left("_hash", F.lit(_PREFIX_DIGITS)))
    counts = keyed.groupBy(F.col(dataset_col).alias("_dataset"), "_prefix").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_dataset").orderBy("_prefix"))
    wanted = counts.withColumn("_before", upto - F.col("_n")).filter(F.col("_before") < n)
    wanted = wanted.select("_dataset", F.col("_prefix").alias("_from"), "_before", "_n")
    same = keyed[dataset_col].eqNullSafe(wanted["_dataset"]) & (keyed["_prefix"] == wanted["_from"])
    near = keyed.join(wanted, same).withColumn("_whole", F.col("_before") + F.col("_n") <= n)
    place = F.row_number().over(Window.partitionBy("_dataset", "_prefix").orderBy("_hash", id_col))
    last = near.filter(~F.col("_whole")).withColumn("_place", place).filter(F.col("_before") + F.col("_place") <= n)
    return near.filter("_whole").select(*df.columns).union(last.select(*df.columns))
