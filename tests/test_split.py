from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cribado.operators.split import stratified_split


def expected(rows, permille=950, seed=42):
    """Largest remainder and a full ranking, in plain Python."""
    by_class = defaultdict(list)
    for row_id, y in rows:
        by_class[y].append(row_id)
    total = len(rows)
    train = total * permille // 1000
    quota = {y: train * len(ids) // total for y, ids in by_class.items()}
    missing = train - sum(quota.values())
    for y in sorted(by_class, key=lambda y: (-(train * len(by_class[y]) % total), y))[:missing]:
        quota[y] += 1
    chosen = set()
    for y, ids in by_class.items():
        ids.sort(key=lambda i: hashlib.md5(f"{i}|{seed}".encode()).hexdigest())
        chosen.update(ids[: 1 if len(ids) == 1 else quota[y]])
    return chosen


@pytest.mark.parametrize(
    "classes",
    [
        [i % 6 for i in range(600)],
        [0] * 900 + [1] * 70 + [2] * 29 + [3],
        [5] * 40,
        [1, 1, 4],
        [2],
        [0, 0, 0, 3, 3, 5],
    ],
)
@pytest.mark.parametrize("permille", [950, 500, 10])
def test_same_members_as_a_full_ranking(spark, classes, permille):
    rows = list(enumerate(classes))
    df = spark.createDataFrame(rows, "id bigint, y int").repartition(3)
    split = {r.id: r.split for r in stratified_split(df, "id", train_permille=permille).collect()}
    assert set(split) == {i for i, _ in rows}
    assert {i for i, name in split.items() if name == "train"} == expected(rows, permille)


def test_a_class_heavy_with_rows_stays_exact(spark):
    df = spark.range(300_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 6).otherwise(3).cast("int").alias("y"))
    counts = Counter()
    for row in stratified_split(df, "id").groupBy("y", "split").count().collect():
        counts[row.split] += row["count"]
        counts[row.y, row.split] = row["count"]
    assert counts["train"] == 285_000
    for y in (0, 2, 3, 4):
        size = counts[y, "train"] + counts[y, "test"]
        assert abs(counts[y, "train"] - size * 0.95) < 1


def test_rows_without_a_class_get_no_split_and_columns_stay(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, None, "b"), (3, 9, "c")], "id bigint, y int, text string")
    rows = stratified_split(df, "id")
    assert rows.columns == ["id", "y", "text", "split"]
    assert {r.id: r.split for r in rows.collect()} == {1: "train", 2: None, 3: None}


def test_rows_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, 0, "a")], "id bigint, y int, text string")
    plan = stratified_split(df, "id")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange Single" in line]
    assert shuffles and not any("text" in line for line in shuffles)
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ids_of_several_columns(spark):
    """Ids that are unique only within a dataset need the dataset as well."""
    rows = [(d, i, i % 3) for d in ("a", "b", "c") for i in range(40)]
    df = spark.createDataFrame(rows, "dataset string, id bigint, y int")
    with pytest.raises(ValueError, match="repeated"):
        stratified_split(df, "id")
    counts = dict(stratified_split(df, ["dataset", "id"]).groupBy("split").count().collect())
    assert counts == {"train": 114, "test": 6}
