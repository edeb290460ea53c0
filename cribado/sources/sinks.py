"""Writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.session import materialize
from cribado.sources.arrow_ipc import ArrowShards
from cribado.sources.files import replace, resolve


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append results; earlier files are never rewritten."""
    if fmt not in ("parquet", "json"):
        raise ValueError("fmt must be 'parquet' or 'json'")
    df.write.mode("append").format(fmt).save(path)


def write_scored(df: DataFrame, path: str) -> None:
    """Scored rows, one folder per `int_score`: a later threshold reads only the folders it keeps.

    At most six files per task and no shuffle. For large files, have the scoring scan give large
    tasks (`spark.sql.files.maxPartitionBytes`).
    """
    df.write.mode("append").partitionBy("int_score").parquet(path)


def write_selected(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Filtered rows to a new folder; `rows_per_file` bounds the size of the files."""
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_shards(df: DataFrame, path: str, name_col: str = "shard", order_by: str | None = None, mode: str = "append", **options: str) -> None:
    """One Arrow shard per value of `name_col`, under that name, with a log of what was completed; see `arrow_ipc`.

    Rows of one shard meet in one task, as they make up one file, in the order of `order_by`. A failed run leaves nothing.
    """
    df.sparkSession.dataSource.register(ArrowShards)
    order = [name_col] if order_by is None else [name_col, order_by]
    together = df.repartition(name_col).sortWithinPartitions(*order)
    together.write.format("arrow_ipc").options(name_col=name_col, **options).mode(mode).save(path)


def write_result_files(df: DataFrame, path: str, name_col: str, id_col: str, indent: bool = False) -> DataFrame:
    """One results file `{id: record}` per value of `name_col`, as other tools of this kind read them; `(name, n_rows)`.

    A record holds the other columns, NULLs included. The rows of a file come together in one task, which writes them one by one
    in the order of their ids and gives the file its name when it is whole.
    """
    others = [c for c in df.columns if c not in (name_col, id_col)]
    record = F.to_json(F.struct(*others), {"ignoreNullFields": "false"})
    rows = df.select(F.col(name_col).alias("name"), F.col(id_col).cast("string").alias("id"), record.alias("record"), F.col(id_col).alias("place"))
    opening, between, closing = ("{\n    ", ",\n    ", "\n}") if indent else ("{", ", ", "}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = resolve(path.rstrip("/"))
        filesystem.create_dir(folder)
        name = out = None
        count, done = 0, []

        def close():
            if out is not None:
                out.write(closing.encode())
                out.close()
                replace(filesystem, f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}", f"{folder}/{name}")
                done.append((name, count))

        for batch in batches:
            for new, number, text in zip(*(batch.column(c).to_pylist() for c in ("name", "id", "record"))):
                if new != name or out is None:
                    close()
                    name, count = new, 0
                    out = filesystem.open_output_stream(f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}")
                out.write(f'{opening if count == 0 else between}"{number}": {text}'.encode())
                count += 1
        close()
        if done:
            columns = [pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "n_rows"])

    together = rows.repartition("name").sortWithinPartitions("name", "place")
    return materialize(together.mapInArrow(write, "name string, n_rows long"))
