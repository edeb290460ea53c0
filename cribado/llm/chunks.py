"""Chunks of whole documents, and questions about keys that go to every other chunk and back.

Comparing all n-grams of a corpus by a plain shuffle moves many times its text. Here documents are first stored
in chunks of some megabytes, in a table bucketed by chunk. A chunk turns its n-grams into numbers, sends each
distinct one once (sorted, as packed differences) to the range of key space it falls in, and gets back one
answer per key in the same order. Answers find their chunk by a join that leaves the stored chunks where
they are. A key that is everywhere costs one entry per chunk.

Tasks hold one chunk, or one range of key space; the number of ranges follows the size of the corpus.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.llm.common import parallelism
from cribado.session import fresh_path, materialize

#: A chunk ends with the document that fills it; a longer document is a chunk by itself.
CHUNK_BYTES = 8_000_000
#: Expected bytes of text whose keys share a range.
RANGE_BYTES = 16_000_000
#: Bytes that are hashed at a time.
BLOCK = 1 << 20

CHUNK_SCHEMA = "chunk long, ids array<long>, sizes array<long>, data binary"
ASK_SCHEMA = "range int, chunk long, payload binary"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (one-to-one)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of a multiplier and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self):
        self.up, self.down = _powers(_MULTIPLIER, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            self.up, self.down = _powers(_MULTIPLIER, n + 1), _powers(_INVERSE, n + 1)
        return self.up, self.down


_POWERS: list[Powers] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        _POWERS.append(Powers())
    return _POWERS[0].upto(n)


#: Words longer than this are hashed one by one.
LONG_WORD = 256
#: Bytes with A-Z folded, and masks of the first n bytes of eight.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit number for every byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


class Chunk:
    """Documents of one stored row; a line feed stands after each, so no word crosses documents."""

    def __init__(self, number: int, ids: list, sizes: np.ndarray, data: bytes):
        self.number, self.ids, self.data = number, ids, data
        self.ends = np.cumsum(sizes + 1) - 1  # places of the line feeds
        self.begins = self.ends - sizes
        self.bytes = np.frombuffer(data, np.uint8)

    def texts(self) -> Iterator[bytes]:
        for begin, end in zip(self.begins.tolist(), self.ends.tolist()):
            yield self.data[begin:end]

    def order_ids(self) -> np.ndarray:
        """Ids for comparing documents; NULL is the largest."""
        return np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the first word of every document plus the number of words."""
        gap = (self.bytes == 32) | ((self.bytes >= 9) & (self.bytes <= 13))
        change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            change = np.concatenate([[0], change])
        starts, ends = change[::2], change[1::2]  # the last byte is a line feed
        return starts, ends, np.append(np.searchsorted(starts, self.begins), len(starts))

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of the bytes of each word; `lower` folds A-Z. Hashes of different seeds are independent.

        Eight bytes at a time go through a mixing step that is not linear, so words of regular structure collide no
        more than others. Very long words are hashed one by one.
        """
        data = FOLDED[self.bytes] if lower else self.bytes
        lanes = np.zeros(len(data) // 8 + 2, "<u8")
        lanes.view(np.uint8)[: len(data)] = data
        sizes = ends - starts
        out = mix64(sizes.astype(np.uint64) * _MULTIPLIER + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            digest = hashlib.blake2b(word, digest_size=8, key=seed.to_bytes(8, "little")).digest()
            out[i] = np.uint64(int.from_bytes(digest, "little"))
        for first in range(0, len(starts), BLOCK):
            part = np.arange(first, min(first + BLOCK, len(starts)))
            part = part[sizes[part] <= LONG_WORD]
            done = 0
            while len(part):
                at, left = starts[part] + done, sizes[part] - done
                lane, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
                value = lanes[lane] >> shift
                value |= np.where(shift > 0, lanes[lane + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
                value &= _MASKS[np.minimum(left, 8)]
                out[part] = mix64((out[part] ^ value) * _MULTIPLIER)
                part, done = part[left > 8], done + 8
        return out


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of `length` consecutive hashes at every place that has them."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = mix64(out * _MULTIPLIER + hashes[i : i + n]) if i % 4 == 3 else out * _MULTIPLIER + hashes[i : i + n]
    return mix64(out)


def window_places(firsts: np.ndarray, length: int) -> np.ndarray:
    """Places where a window of this length fits into its document, from the documents' first words."""
    counts = np.maximum(np.diff(firsts) - length + 1, 0)
    skipped = np.repeat(firsts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(counts.sum()) + skipped


def compress(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def decompress(blob: bytes) -> bytes:
    return zstandard.decompress(blob)


def pack(values: np.ndarray) -> bytes:
    """Bytes of the values, those of equal weight together, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return compress(planes.tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(blob: bytes, kind=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(blob, kind), dtype=kind)


def pack_parts(*blobs: bytes) -> bytes:
    return np.array([len(b) for b in blobs], np.uint32).tobytes() + b"".join(blobs)


def unpack_parts(blob: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(blob[: 4 * n], np.uint32).tolist()
    at, out = 4 * n, []
    for size in sizes:
        out.append(blob[at : at + size])
        at += size
    return out


def pack_bits(flags: np.ndarray) -> bytes:
    return compress(np.packbits(flags).tobytes())


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(decompress(blob), np.uint8), count=n).astype(bool)


def range_starts(keys: np.ndarray, ranges: int, bits: int = 64) -> np.ndarray:
    """Where each range of key space begins in sorted keys, and their number."""
    bounds = np.array([(i << bits) // ranges for i in range(ranges)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def _gather(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row():
            data = b"\n".join([*texts, b""])
            columns = [[(part << 32) + count], [ids], [[len(t) for t in texts]], [data]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "ids", "sizes", "data"]
            )

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                ids.append(number)
                texts.append(text)
                size += len(text) + 1
                if size >= CHUNK_BYTES:
                    yield row()
                    ids, texts, size, count = [], [], 0, count + 1
        if ids:
            yield row()

    return run


class Store:
    """The stored chunks of a table, and how many ranges of key space its size calls for."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        spark = docs.sparkSession
        rows = docs.select(
            F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
        )
        name, buckets = f"chunks_{uuid.uuid4().hex}", parallelism(docs)
        (
            rows.mapInArrow(_gather(id_col), CHUNK_SCHEMA)
            .write.format("parquet")
            .option("path", fresh_path(spark, "chunks"))
            .option("compression", "zstd")
            .bucketBy(buckets, "chunk")
            .saveAsTable(name)
        )
        self.table = spark.table(name)
        size = self.table.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
        self.ranges = max(buckets, math.ceil(size / RANGE_BYTES))

    def run(self, work: Callable, schema: str, *answers: DataFrame) -> DataFrame:
        """`work(chunk, *blobs)` yields rows for each chunk; answers are `(chunk, range, payload)` or `(chunk, payload)`.

        For answers by range, the blob is the list of payloads in the order of ranges (ranges without any are
        left out); for one payload per chunk, it is the payload or None.
        """
        rows = self.table
        ranged = []
        for i, answer in enumerate(answers):
            ranged.append("range" in answer.columns)
            if ranged[-1]:
                parts = F.sort_array(F.collect_list(F.struct("range", "payload")))
                answer = answer.groupBy("chunk").agg(F.transform(parts, lambda p: p["payload"]).alias("payload"))
            rows = rows.join(answer.select("chunk", F.col("payload").alias(f"answer{i}")), "chunk", "left")
        names = [part.split()[0] for part in schema.split(", ")]

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    value = lambda c: batch.column(c)[k]  # noqa: E731, B023
                    chunk = Chunk(
                        value("chunk").as_py(), value("ids").as_py(), np.asarray(value("sizes").values), value("data").as_py()
                    )
                    given = [value(f"answer{i}").as_py() or ([] if r else None) for i, r in enumerate(ranged)]
                    yield from in_batches(work(chunk, *given), names, kinds)

        kinds = _kinds(schema)
        return rows.mapInArrow(mapped, schema)


_ARROW = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}


def _kinds(schema: str) -> list[pa.DataType]:
    return [_ARROW[part.split()[1]] for part in schema.split(", ")]


def in_batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded number of rows and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, list)))
        if len(held) >= most or size > CHUNK_BYTES:
            yield _batch(held, names, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def answer(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """`(chunk, range, payload)`: `reply` gets all payloads of one range and returns one for each."""

    def grouped(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        payloads = reply(table.column("payload").to_pylist())
        return pa.table(
            {"chunk": table.column("chunk"), "range": table.column("range"), "payload": pa.array(payloads, pa.binary())}
        )

    return asked.groupBy("range").applyInArrow(grouped, "chunk long, range int, payload binary")


def split_kinds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store `(kind, chunk, range, payload)` once; kind 0 is the chunk's own state, kind 1 goes to the ranges."""
    stored = materialize(rows)
    state = stored.filter("kind = 0").select("chunk", "payload")
    return state, stored.filter("kind = 1").select("range", "chunk", "payload")


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their counts, and for each input its place among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = group
    return ordered[new], np.bincount(group, minlength=int(new.sum())), inverse
