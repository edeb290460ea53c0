"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected `target / size of the source` times. Within a source, documents
stand in the order of their size; the prefix sum of the expected copies plus one offset per source
crosses an integer once for every copy that is emitted. In this order what one document takes too much,
the next of nearly the same size takes too little: a source misses its target by no more than about
twice its longest document.

The position within a source comes from a range partition, counts per (partition, source) and local
numbers, so a source with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from cribado.llm.common import n_words, parallelism
from cribado.session import materialize

#: Weights in the order of the sources, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: No source is taken more often than this.
MOST = 2.0


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add `weight` and `target` to one row per source (`source`, `source_size`).

    What stands above `most` times a source's size is reshared by weight until none is above. That ends
    where each source has the lesser of its limit and weight times a common level; sources reach their
    limit in the order of limit per weight. The windows below see one row per source, never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    limit = F.col("source_size") * most
    ranked = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    )
    by_level = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("total") - F.col("limits_before")) / F.col("weight_onwards")
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("limits_before", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("weight_onwards", F.sum("weight").over(onwards))
        .withColumn("full", level * F.col("weight") >= limit)
        .withColumn("first", F.min(F.when(~F.col("full"), F.struct(limit / F.col("weight"), level))).over(everything))
    )
    common = F.col("first").getField("col2")
    target = F.when(F.col("full"), limit).otherwise(F.col("weight") * common)
    return filled.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted partition within each source, from 0."""
    part = TaskContext.get().partitionId()
    last, count = object(), 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sources = batch.column("source").dictionary_encode()
        codes = np.asarray(sources.indices.fill_null(-1))
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        first = batch.column("source")[0].as_py()
        offsets = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        if first == last:
            end = starts[1] if len(starts) > 1 else n
            offsets[:end] += count
        last, count = batch.column("source")[n - 1].as_py(), int(offsets[-1]) + 1
        columns = [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(offsets, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place"])


def _taken(
    docs: DataFrame, keys: list[Column], id_col: str, text_col: str, source_col: str, weights, share: float, most: float, seed: int
) -> DataFrame:
    """`id`, `source`, `size`, `source_size`, `target`, `copies`, and the `keys` as `key0`, `key1`."""
    named = [key.alias(f"key{i}") for i, key in enumerate(keys)]
    sized = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), *named)
    )  # the range partition reads its input twice; so the texts are read once
    ordered = sized.repartitionByRange(
        max(2, parallelism(docs)), F.col("source"), F.col("size"), F.xxhash64("id"), F.col("id")
    ).sortWithinPartitions("source", "size", F.xxhash64("id"), "id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    placed = materialize(ordered.mapInArrow(_numbered, f"{schema}, part int, place long"))
    parts = placed.groupBy("source", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    goals = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    same = starts["source"].eqNullSafe(goals["source"])
    starts = starts.join(goals, same).select(
        starts["source"].alias("start_source"), starts["part"].alias("start_part"), "start", "source_size", "target"
    )
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = F.col("start") + F.col("place")
    copies = F.floor((place + 1) * each + offset) - F.floor(place * each + offset)
    kept = ["id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *(f"key{i}" for i in range(len(keys)))]
    same = F.col("source").eqNullSafe(F.col("start_source")) & (F.col("part") == F.col("start_part"))
    return placed.join(starts, same).select(*kept)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 42,
) -> DataFrame:
    """How often each document is taken: `id_col`, `source`, `size`, `source_size`, `target`, `copies`.

    Size is the number of words. NULL texts have size 0 and take nothing; NULL sources are one source, the
    last; repeated rows are documents of their own. An empty table gives an empty result. Other columns are
    not read. Copies never exceed `most` rounded up, and reruns agree: only the seed is random.
    """
    return _taken(docs, [], id_col, text_col, source_col, weights, share, most, seed).withColumnRenamed("id", id_col)


def repeat_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 42,
) -> DataFrame:
    """The mixed corpus: each row as often as `mix` takes it, columns as they were, whatever their names.

    Rows find their number by a hash of 128 bits over all their columns, so rows that share an id, or have none, are taken each by
    its own number; what equal rows are taken together goes to one of them. NULL texts take nothing and are left out;
    an empty table gives an empty result.
    """
    hashed = [F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in docs.schema]
    keys = [F.xxhash64(*hashed), F.xxhash64(F.lit(seed), *reversed(hashed))]
    taken = _taken(docs, keys, id_col, text_col, source_col, weights, share, most, seed)
    taken = taken.groupBy("key0", "key1").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, *(key.alias(f"key{i}") for i, key in enumerate(keys)))
    found = rows.join(taken.filter("copies > 0"), ["key0", "key1"])
    alone, equal = found.filter("rows = 1"), found.filter("rows > 1").dropDuplicates(["key0", "key1"])
    numbered = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return alone.union(equal).select("row", numbered).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )
