"""Results files, each one JSON object `{key: record}`, cut into byte ranges wherever their lines end.

Where a record begins cannot be seen from the middle of a file: a brace may stand in a string. So every range is read
once to count its quotes and braces, for both cases: that it begins within a string, and that it does not. Running sums over the
ranges of a file then tell how each of them begins, and whether the file is whole. With that, the tasks
cut out the records that begin in their ranges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cribado.session import materialize
from cribado.sources.files import resolve

SPLIT_BYTES = 32 << 20
#: Bytes looked at before a range, for backslashes and the key of its first record; more if that does not do.
LOOK_BACK = 4096
#: Bytes read at a time behind a range, to the end of its last record.
LOOK_AHEAD = 1 << 20

QUOTE, BACKSLASH, OPEN, CLOSE = b'"\\{}'


def _escaped_at(source: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes stands before `start`."""
    size = LOOK_BACK
    while True:
        begin = max(0, start - size)
        source.seek(begin)
        before = source.read(start - begin)
        count = len(before) - len(before.rstrip(b"\\"))
        if count < len(before) or begin == 0:
            return count % 2 == 1
        size *= 2


def structure(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes that count and of all braces, and for each brace how many of these quotes stand before it."""
    chars = np.frombuffer(data, np.uint8)
    places = np.arange(len(chars))
    last_other = np.maximum.accumulate(np.where(chars != BACKSLASH, places, -1)) if len(chars) else places
    quotes = np.flatnonzero(chars == QUOTE)
    before = np.where(quotes > 0, last_other[quotes - 1], -1)
    run = quotes - 1 - before + ((before < 0) & escaped)
    quotes = quotes[run % 2 == 0]
    braces = np.flatnonzero((chars == OPEN) | (chars == CLOSE))
    return quotes, braces, np.searchsorted(quotes, braces)


def _summary(path: str, start: int, stop: int) -> tuple[int, int, int]:
    """Quotes of a range, and by how many braces it goes deeper if it begins outside of a string, and within one."""
    filesystem, name = resolve(path)
    with filesystem.open_input_file(name) as source:
        escaped = _escaped_at(source, start)
        source.seek(start)
        data = source.read(stop - start)
    if start == 0 and data.strip() and not data.lstrip().startswith(b"{"):
        raise ValueError(f"malformed results file, no object: {path}")
    quotes, braces, passed = structure(data, escaped)
    deeper = np.where(np.frombuffer(data, np.uint8)[braces] == OPEN, 1, -1)
    return len(quotes), int(deeper[passed % 2 == 0].sum()), int(deeper[passed % 2 == 1].sum())


def _key(before: bytes, path: str) -> str:
    """The key that stands at the end of `before`, with its colon."""
    text = before.rstrip()
    end = len(text.removesuffix(b":").rstrip()) - 1 if text.endswith(b":") else -1
    begin = end
    while begin > 0:
        begin = text.rfind(b'"', 0, begin)
        slashes = len(text[:begin]) - len(text[:begin].rstrip(b"\\"))
        if begin >= 0 and slashes % 2 == 0:
            return json.loads(text[begin : end + 1])
    raise ValueError(f"malformed results file, a record without a key: {path}")


def _records(path: str, length: int, start: int, stop: int, in_string: bool, depth: int) -> Iterator[tuple[str, bytes]]:
    """Key and text of the records whose brace lies in the range."""
    filesystem, name = resolve(path)
    with filesystem.open_input_file(name) as source:
        escaped = _escaped_at(source, start)
        back = max(0, start - LOOK_BACK)
        source.seek(back)
        data = source.read(stop - back)
        shift, end, more = start - back, stop, LOOK_AHEAD
        while True:
            quotes, braces, passed = structure(data[shift:], escaped)
            outside = braces[(passed + in_string) % 2 == 0]
            chars = np.frombuffer(data, np.uint8)
            level = depth + np.cumsum(np.where(chars[shift + outside] == OPEN, 1, -1))
            begins = outside[(chars[shift + outside] == OPEN) & (level == 2)]
            begins = begins[begins < stop - start]
            ends = outside[(chars[shift + outside] == CLOSE) & (level == 1)]
            if depth >= 2:  # the first end belongs to a record of an earlier range
                ends = ends[1:]
            if len(ends) >= len(begins) or end >= length:
                break
            source.seek(end)
            data += source.read(more)
            end, more = min(end + more, length), more * 2
    if len(ends) < len(begins):
        raise ValueError(f"malformed results file, a record without an end: {path}")
    for begin, last in zip((begins + shift).tolist(), (ends + shift).tolist()):
        yield _key(data[max(0, begin - LOOK_BACK) : begin], path), data[begin : last + 1]


def _ranges(files: DataFrame, split_bytes: int) -> DataFrame:
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.filter("length > 0").select("path", "length", starts.alias("start"))
    return ranges.withColumn("stop", F.least(F.col("start") + split_bytes, F.col("length")))


def read_records(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """`path`, `key`, `record` (JSON text) of all records of the files (`path`, `length`), in any layout.

    A file that ends within a string or an object, or does not begin with one, is an error as soon as this is called. Empty
    files and objects have no records. Values that are no objects are passed over.
    """
    ranges = materialize(_ranges(files, split_bytes))
    count = max(1, ranges.count())

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [_summary(r["path"], r["start"], r["stop"]) for r in rows]
            if rows:
                added = [pa.array(list(column), pa.int64()) for column in zip(*found)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "quotes", "outside", "inside"])

    schema = "path string, length long, start long, stop long"
    spread = ranges.repartitionByRange(count, "path", "start")
    summed = spread.mapInArrow(summaries, f"{schema}, quotes long, outside long, inside long")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = summed.withColumn("in_string", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    begun = begun.withColumn("deeper", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    begun = materialize(begun.withColumn("depth", F.coalesce(F.sum("deeper").over(earlier), F.lit(0))))
    ends = begun.filter("stop = length").select("path", (F.col("depth") + F.col("deeper")).alias("depth"))
    quotes = begun.groupBy("path").agg((F.sum("quotes") % 2).alias("open"))
    cut = ends.join(quotes, "path").filter("depth <> 0 OR open <> 0").select("path").take(3)
    if cut:
        raise ValueError(f"malformed or truncated results file: {', '.join(row.path for row in cut)}")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                held, size = [], 0
                for key, record in _records(r["path"], r["length"], r["start"], r["stop"], r["in_string"], r["depth"]):
                    held.append((r["path"], key, record.decode()))
                    size += len(record)
                    if size > LOOK_AHEAD:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    known = begun.select("path", "length", "start", "stop", "in_string", "depth")
    return known.repartitionByRange(count, "path", "start").mapInArrow(records, "path string, key string, record string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "key", "record"])
