"""Data source `arrow_ipc`: Arrow IPC shards, stream or file format, read and written.

    spark.dataSource.register(ArrowShards)
    spark.read.format("arrow_ipc").load("/corpus/")
    df.write.format("arrow_ipc").option("name_col", "shard").mode("append").save("/scored/")

Options for reading: `path` (a file or a folder; `load` also takes a list), `suffix` (default `.arrow`), `recursive`
(default false), `columns` (comma-separated, default all), `split_bytes` (default 128 MiB), `provenance` (default false:
adds `shard_path` and the row's position `row_index`, which together identify a row of a corpus without ids),
`filesystem` (`module:function`, for file systems Arrow does not know; the function gets a path).

A shard larger than `split_bytes` is shared out among several tasks by byte range, on any storage: each finds its
record batches by their headers and reads no others. `where` (a JSON list of `[column, operator, value]`, all of which
must hold) is compared with the least and largest values noted in the headers by the writer below, or in an index
(`index_shards`): batches that cannot match are not read. The rows of other batches come whole, so filter them too;
`tables.read_arrow` does both. Spark's own pushdown is not used: Spark keeps pushed filters with the loaded table, and another
scan of the same DataFrame would be cut by them.

Options for writing: `path`, `name_col` (default `shard`: the file each row belongs to, which is not written),
`layout` (`stream` or `file`), `batch_rows` (default 1000), `filesystem`. The rows of a file have to come together in one task, in
order (`sinks.write_shards` sees to that). Files are written aside and moved to their names when all tasks are done;
then one entry per file (name, bytes, second of its last change, rows) goes to the log in `commits`. If anything fails before, nothing
is left. Mode `append` never replaces a file, `overwrite` replaces those it writes again; no other mode is known.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from cribado.functions.fixed import SHARD_SUFFIX
from cribado.sources.arrow_messages import RECORD_BATCH, STATS_KEY, Header, Shard, statistics
from cribado.sources.files import is_local, replace, resolve

ROWS_PER_SLICE = 10_000
SHARD_PATH = "shard_path"
ROW_INDEX = "row_index"
INDEX_SUFFIX = ".index"
LOG, ASIDE = "commits", "_aside"


class ShardPart(InputPartition):
    """The record batches of one shard that begin in a byte range."""

    def __init__(self, root: str, path: str, size: int, start: int, stop: int):
        super().__init__(path)
        self.root, self.path, self.size, self.start, self.stop = root, path, size, start, stop


def _true(value: str) -> bool:
    return value.lower() == "true"


def _open(filesystem: pafs.FileSystem, path: str) -> pa.NativeFile:
    return pa.memory_map(path) if is_local(filesystem) else filesystem.open_input_file(path)


def _exists(filesystem: pafs.FileSystem, path: str) -> bool:
    return filesystem.get_file_info(path).type != pafs.FileType.NotFound


class ArrowShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def roots(self) -> list[str]:
        """The paths given to `load`; Spark passes several as a JSON list."""
        return [self.options["path"]] if "path" in self.options else json.loads(self.options["paths"])

    def resolve(self, path: str) -> tuple[pafs.FileSystem, str]:
        return resolve(path, self.options.get("filesystem", ""))

    def files(self, root: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
        filesystem, path = self.resolve(root)
        info = filesystem.get_file_info(path)
        if info.type == pafs.FileType.File:
            return filesystem, [info]
        recursive = _true(self.options.get("recursive", "false"))
        suffix = self.options.get("suffix", SHARD_SUFFIX)
        listed = filesystem.get_file_info(pafs.FileSelector(path, recursive=recursive))
        files = [f for f in listed if f.type == pafs.FileType.File and f.path.endswith(suffix) and f"/{ASIDE}/" not in f.path]
        if not files:
            raise FileNotFoundError(f"no {suffix} shards in {root}")
        return filesystem, sorted(files, key=lambda f: f.path)

    def schema(self) -> StructType:
        filesystem, files = self.files(self.roots()[0])
        with _open(filesystem, files[0].path) as source:
            schema = from_arrow_schema(Shard(source, files[0].size).schema)
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        schema = StructType([schema[c] for c in wanted]) if wanted else schema
        if _true(self.options.get("provenance", "false")):
            schema = StructType(schema.fields).add(SHARD_PATH, StringType()).add(ROW_INDEX, LongType())
        return schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowShardReader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowShardWriter(self, schema, overwrite)


#: `(column, operator, value)`; `in` takes a list, `null` and `not null` take nothing.
Condition = tuple[str, str, object]
_COMPARED = {
    "=": lambda least, largest, v: least <= v <= largest,
    "<": lambda least, largest, v: least < v,
    "<=": lambda least, largest, v: least <= v,
    ">": lambda least, largest, v: largest > v,
    ">=": lambda least, largest, v: largest >= v,
    "in": lambda least, largest, vs: any(v is not None and least <= v <= largest for v in vs),
}
OPERATORS = (*_COMPARED, "null", "not null")


def may_match(condition: Condition, stats: dict, rows: int) -> bool:
    """Whether a batch with these statistics can have a row for which the condition holds; true if that is unknown."""
    column, operator, value = condition
    if column not in stats:
        return True
    least, largest, nulls = stats[column]
    if operator == "null":
        return nulls > 0
    if operator == "not null":
        return nulls < rows
    if nulls == rows:
        return False  # NULL compares with nothing
    if least is None:
        return True
    try:
        return _COMPARED[operator](least, largest, value)
    except TypeError:
        return True


class ArrowShardReader(DataSourceReader):
    def __init__(self, source: ArrowShards, schema: StructType):
        self.source = source
        self.split_bytes = int(source.options.get("split_bytes", 128 << 20))
        self.arrow_schema = to_arrow_schema(schema)
        self.where: list[Condition] = [tuple(c) for c in json.loads(source.options.get("where", "[]"))]
        if unknown := [c for c in self.where if len(c) != 3 or c[1] not in OPERATORS]:
            raise ValueError(f"not a condition: {unknown[0]}")

    def partitions(self) -> list[InputPartition]:
        parts = []
        for root in self.source.roots():
            for info in self.source.files(root)[1]:
                for start in range(0, max(info.size, 1), self.split_bytes):
                    parts.append(ShardPart(root, info.path, info.size, start, start + self.split_bytes))
        return parts

    def _headers(self, filesystem: pafs.FileSystem, shard: Shard, part: ShardPart) -> Iterator[tuple[int | None, Header]]:
        """The batches of a part, from the shard's index if it has one that is not out of date."""
        index = part.path + INDEX_SUFFIX
        if _exists(filesystem, index):
            with filesystem.open_input_file(index) as source:
                noted = json.loads(source.read())
            if noted["size"] == shard.size and not noted["dictionaries"]:
                first = 0
                for number, (offset, head, body, rows, stats) in enumerate(noted["batches"]):
                    if part.start <= offset < part.stop:
                        yield first, Header(RECORD_BATCH, offset, head, body, rows, stats, number)
                    first += rows
                return
        yield from shard.headers(part.start, part.stop, ROW_INDEX in self.arrow_schema.names)

    def read(self, partition: ShardPart) -> Iterator[pa.RecordBatch]:
        filesystem, _ = self.source.resolve(partition.root)
        columns = self.arrow_schema.names
        with _open(filesystem, partition.path) as source:
            shard = Shard(source, source.size())
            for first_row, header in self._headers(filesystem, shard, partition):
                if not all(may_match(c, header.stats, header.rows) for c in self.where):
                    continue
                batch = shard.batch(header, columns)
                for start in range(0, batch.num_rows, ROWS_PER_SLICE):
                    rows = batch.slice(start, ROWS_PER_SLICE)
                    place = (first_row or 0) + start
                    made = [self._column(rows, shard, f, partition.path, place) for f in self.arrow_schema]
                    yield pa.RecordBatch.from_arrays(made, schema=self.arrow_schema)

    @staticmethod
    def _column(rows: pa.RecordBatch, shard: Shard, field: pa.Field, path: str, first_row: int) -> pa.Array:
        if field.name in shard.schema.names:
            return rows.column(field.name).cast(field.type)
        if field.name == SHARD_PATH:
            return pa.repeat(pa.scalar(path, field.type), rows.num_rows)
        if field.name == ROW_INDEX:
            return pa.array(range(first_row, first_row + rows.num_rows), field.type)
        raise KeyError(f"{path} has no column {field.name}")


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (name, where it lies, rows)."""

    files: list[tuple[str, str, int]]


class ArrowShardWriter(DataSourceArrowWriter):
    def __init__(self, source: ArrowShards, schema: StructType, overwrite: bool):
        self.source, self.overwrite = source, overwrite
        self.name_col = source.options.get("name_col", "shard")
        self.layout = source.options.get("layout", "stream")
        self.batch_rows = int(source.options.get("batch_rows", 1000))
        if self.layout not in ("stream", "file"):
            raise ValueError("layout must be 'stream' or 'file'")
        if self.name_col not in schema.names:
            raise ValueError(f"no column {self.name_col} to name the shards by")
        self.arrow_schema = to_arrow_schema(StructType([f for f in schema.fields if f.name != self.name_col]))
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        filesystem, path = self.source.resolve(self.source.options["path"])
        return filesystem, path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        filesystem, folder = self._folder()
        aside = f"{folder}/{ASIDE}/{self.job}/{TaskContext.get().taskAttemptId()}"
        filesystem.create_dir(aside)
        files: list[tuple[str, str, int]] = []
        names: set[str] = set()
        sink = writer = name = None
        rows = 0

        def close():
            if writer is not None:
                writer.close()
                sink.close()
                files.append((name, f"{aside}/{name}", rows))

        for batch in iterator:
            for new, part in _runs(batch, self.name_col):
                if new != name or writer is None:
                    close()
                    if new is None or "/" in new or new in names:
                        raise ValueError(f"rows of shard {new!r} are not together" if new in names else f"no file name: {new!r}")
                    name, rows = new, 0
                    names.add(name)
                    sink = filesystem.open_output_stream(f"{aside}/{name}")
                    opener = pa.ipc.new_stream if self.layout == "stream" else pa.ipc.new_file
                    writer = opener(sink, self.arrow_schema)
                for start in range(0, part.num_rows, self.batch_rows):
                    piece = part.slice(start, self.batch_rows).select(self.arrow_schema.names)
                    piece = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(piece.columns, self.arrow_schema)], schema=self.arrow_schema)
                    writer.write_batch(piece, custom_metadata={STATS_KEY: json.dumps(statistics(piece)).encode()})
                    rows += piece.num_rows
        close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, folder = self._folder()
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for name, _, _ in files]
        try:
            if len(set(names)) < len(names):
                twice = sorted({n for n in names if names.count(n) > 1})[:3]
                raise ValueError(f"rows of one shard in several tasks: {', '.join(twice)}")
            there = [n for n in names if _exists(filesystem, f"{folder}/{n}")]
            if there and not self.overwrite:
                raise FileExistsError(f"already there: {', '.join(there[:3])}")
        except Exception:
            self.abort(messages)
            raise
        entries = []
        for name, aside, rows in files:
            replace(filesystem, aside, f"{folder}/{name}")
            info = filesystem.get_file_info(f"{folder}/{name}")
            entries.append({"name": name, "length": info.size, "modified": info.mtime_ns // 10**9, "n_rows": rows})
        filesystem.create_dir(f"{folder}/{LOG}")
        with filesystem.open_output_stream(f"{folder}/{LOG}/{self.job}.json") as log:
            log.write("".join(json.dumps(e) + "\n" for e in entries).encode())
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Remove what lies aside of this job."""
        filesystem, folder = self._folder()
        if _exists(filesystem, f"{folder}/{ASIDE}/{self.job}"):
            filesystem.delete_dir(f"{folder}/{ASIDE}/{self.job}")


def _runs(batch: pa.RecordBatch, name_col: str) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """Consecutive rows with one name."""
    names = batch.column(name_col).to_pylist()
    start = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[start]:
            yield names[start], batch.slice(start, i - start)
            start = i


def index_shards(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, **options: str) -> DataFrame:
    """Note beside every shard where its batches are and what values `columns` (default all) have in them.

    For shards other tools have written: reads these columns once, one shard a task, and writes a small file with the
    shard's name plus `.index`. An index of a shard that has changed its size is not used. Returns `shard_path`,
    `batches`, `rows`, `bytes` per shard.
    """
    source = ArrowShards({**options, "paths": json.dumps([paths] if isinstance(paths, str) else paths)})
    found = [(root, f.path, f.size) for root in source.roots() for f in source.files(root)[1]]
    listed = spark.createDataFrame(found, "root string, path string, size long").repartition(len(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, _ = source.resolve(row["root"])
                noted, rows = [], 0
                with _open(filesystem, row["path"]) as file:
                    shard = Shard(file, row["size"])
                    wanted = columns if columns is not None else shard.schema.names
                    plain = len(shard.prefix)
                    for _, header in shard.headers():
                        noted.append([header.offset, header.head, header.body, header.rows, statistics(shard.batch(header, wanted), wanted)])
                        rows += header.rows
                    dictionaries = len(shard.prefix) > plain
                with filesystem.open_output_stream(row["path"] + INDEX_SUFFIX) as out:
                    out.write(json.dumps({"size": row["size"], "dictionaries": dictionaries, "batches": noted}).encode())
                made = [[row["path"]], [len(noted)], [rows], [row["size"]]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=["shard_path", "batches", "rows", "bytes"])

    return spark.createDataFrame(
        listed.mapInArrow(run, "shard_path string, batches long, rows long, bytes long").collect(),
        "shard_path string, batches long, rows long, bytes long",
    )
