"""Sharding through fixed virtual slots.

A record is hashed into one of some thousands of slots; that never changes. Which shard a slot belongs to stands in a
small map, which is stored in versions: the first deals the slots out in turn, and each rebalancing or growth
edits the last one by moving whole slots. Bytes are added up per slot, so the driver plans over as many
numbers as there are slots, however large the corpus is. No row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cribado.session import fresh_path, materialize

#: Virtual slots: fixed for the life of a corpus, as every record's slot depends on it.
SLOTS = 8192
#: Bytes a record takes besides its text.
OVERHEAD = 8
#: Names that `place_records` adds while it works.
WORK_COLUMNS = ("_part", "_place")


def slot_of(*parts: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, from whatever tells records apart."""
    return F.pmod(F.xxhash64(*parts), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """The shard of every slot before anything is known of their load: dealt out in turn."""
    if not 0 < shards <= slots:
        raise ValueError("there must be at least one shard, and no more shards than slots")
    return np.arange(slots) % shards


def _closest(values: np.ndarray, wanted: float, below: float) -> int:
    """Place of the value closest to `wanted` that is above 0 and below `below`, or -1."""
    fits = (values > 0) & (values < below)
    return int(np.argmin(np.where(fits, np.abs(values - wanted), np.inf))) if fits.any() else -1


def rebalance(shard_of: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """An edited map with shards of nearly equal load.

    Shards above the mean give up slots that fit into what they have too much; these go, largest first, to the
    least loaded shard. Then the fullest and the emptiest shard trade one slot, or one against another, as
    long as that brings them closer. Each trade lowers the sum of squares, so it ends. The largest slot
    limits how even it gets.
    """
    shard_of, load = shard_of.copy(), load.astype(np.int64)
    total = np.bincount(shard_of, load, shards).astype(np.int64)
    mean = load.sum() / shards
    loose = []
    for shard in np.flatnonzero(total > mean):
        own = np.flatnonzero(shard_of == shard)
        for slot in own[np.argsort(-load[own], kind="stable")]:
            if 0 < load[slot] <= total[shard] - mean:
                total[shard] -= load[slot]
                loose.append(slot)
    for slot in sorted(loose, key=lambda s: (-load[s], s)):
        shard_of[slot] = np.argmin(total)
        total[shard_of[slot]] += load[slot]
    for _ in range(4 * len(load)):
        full, empty = int(np.argmax(total)), int(np.argmin(total))
        gap = total[full] - total[empty]
        mine, theirs = np.flatnonzero(shard_of == full), np.flatnonzero(shard_of == empty)
        if (best := _closest(load[mine], gap / 2, gap)) >= 0:
            moved = load[mine[best]]
            shard_of[mine[best]] = empty
        else:
            traded = (load[mine][:, None] - load[theirs][None, :]).reshape(-1)
            if not len(traded) or (best := _closest(traded, gap / 2, gap)) < 0:
                break
            moved = traded[best]
            shard_of[mine[best // len(theirs)]], shard_of[theirs[best % len(theirs)]] = empty, full
        total[full] -= moved
        total[empty] += moved
    return shard_of


def grow(shard_of: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """A map with one shard more than `shards`, which takes slots from the fullest; no others move."""
    shard_of, load = shard_of.copy(), load.astype(np.int64)
    total = np.bincount(shard_of, load, shards + 1).astype(np.int64)
    mean = load.sum() / (shards + 1)
    for _ in range(len(load)):
        full = int(np.argmax(total[:shards]))
        own = np.flatnonzero(shard_of == full)
        fits = own[(load[own] > 0) & (total[shards] + load[own] <= mean)]
        if not len(fits):
            break
        slot = fits[np.argmax(load[fits])]
        shard_of[slot] = shards
        total[full] -= load[slot]
        total[shards] += load[slot]
    return shard_of


def write_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray, load: np.ndarray) -> None:
    """Store a version of the map: `slot`, `shard`, `bytes`. A version is written once; one that is there is an error."""
    rows = [(i, int(s), int(b)) for i, (s, b) in enumerate(zip(shard_of, load))]
    df = spark.createDataFrame(rows, "slot int, shard int, bytes long").coalesce(1)
    df.write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """`slot`, `shard`, `bytes`, `version` of one version, by default of the latest."""
    versions = spark.read.schema("slot int, shard int, bytes long, version int").parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version)


def slot_loads(sized: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes per slot of rows with `virtual_slot` and `size`: one number per slot reaches the driver."""
    load = np.zeros(slots, np.int64)
    for slot, size in sized.groupBy("virtual_slot").agg(F.sum("size")).collect():
        load[slot] = size
    return load


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a partition within each shard, from 0."""
    part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for batch in batches:
        shard = np.asarray(batch.column("shard"))
        n = len(shard)
        if not n:
            continue
        counts = np.bincount(shard, minlength=len(seen))
        seen = np.append(seen, np.zeros(len(counts) - len(seen), np.int64))
        order = np.argsort(shard, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        place += seen[shard]
        seen += counts
        columns = [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(place, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *WORK_COLUMNS])


def number_within_shards(placed: DataFrame) -> DataFrame:
    """Add `slot`: the row's place in its `shard`, gapless from 0, without a shuffle of the rows.

    Rows are numbered within their partition and stored with its number; the counts of the earlier partitions,
    one per (partition, shard), make up the rest.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    stored = materialize(placed.mapInArrow(_numbered, f"{schema}, _part int, _place long"))
    counts = stored.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    return stored.join(starts, ["shard", "_part"]).select(
        *placed.columns, (F.col("_start") + F.col("_place")).alias("slot")
    )


def place_records(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, path: str | None = None
) -> DataFrame:
    """The shard of every record: `id_col`, `size`, `text_crc32`, `virtual_slot`, `shard`, `slot`.

    Bytes per slot are counted, the map is written to `path` (default: a new folder in the shared folder) as version 0,
    dealt out in turn, and as version 1, rebalanced; version 1 places the records. `slot` is the place in
    the shard, from 0 without gaps.

    A record is told apart by id, length and checksum, so rows that share an id, or have none, spread over slots as
    soon as their texts differ; wholly repeated rows share a slot, and each is placed. NULL and empty
    texts have the size of the overhead. An empty table gives an empty result. Other columns are not read,
    so their names do not matter. Texts are hashed whole.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    path = path or fresh_path(spark, "slot-map")
    sized = docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    sized = materialize(sized.withColumn("virtual_slot", slot_of(F.col(id_col), F.col("size"), F.col("text_crc32"), slots=slots)))
    load, dealt = slot_loads(sized, slots), first_map(shards, slots)
    write_map(spark, path, 0, dealt, load)
    write_map(spark, path, 1, rebalance(dealt, load, shards), load)
    latest = read_map(spark, path, 1).select(F.col("slot").alias("virtual_slot"), "shard")
    placed = sized.join(F.broadcast(latest), "virtual_slot")  # as many rows as slots
    return number_within_shards(placed.select(id_col, "size", "text_crc32", "virtual_slot", "shard"))


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place_records(docs, 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
