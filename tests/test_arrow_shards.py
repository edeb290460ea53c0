"""Arrow shards by byte range, skipped batches, written shards and their log."""

from __future__ import annotations

import json
import os

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from cribado.operators.shards import completed_shards, pending_shards
from cribado.sources import sinks, tables
from cribado.sources.arrow_ipc import ArrowShards, index_shards, may_match
from cribado.sources.arrow_messages import Shard, statistics

COUNTING = '''
import os
import pyarrow.fs as pafs
from fsspec_like import CountingHandler

def make(path):
    return pafs.PyFileSystem(CountingHandler()), path.split("://", 1)[1]
'''
HANDLER = '''
import os, uuid
import pyarrow as pa
import pyarrow.fs as pafs

LOG = {log!r}

class CountingFile:
    """Notes every read in a file of its process."""
    def __init__(self, path):
        self.raw, self.path, self.closed = open(path, "rb"), path, False
    def read(self, n=-1):
        data = self.raw.read(n)
        with open(f"{{LOG}}/{{os.getpid()}}", "a") as log:
            log.write(f"{{os.path.basename(self.path)}} {{len(data)}}\\n")
        return data
    def seek(self, *a): return self.raw.seek(*a)
    def tell(self): return self.raw.tell()
    def readable(self): return True
    def writable(self): return False
    def seekable(self): return True
    def close(self):
        self.closed = True
        self.raw.close()

class CountingHandler(pafs.FileSystemHandler):
    local = pafs.LocalFileSystem()
    def get_type_name(self): return "counting"
    def normalize_path(self, path): return path
    def get_file_info(self, paths): return self.local.get_file_info(paths)
    def get_file_info_selector(self, selector): return self.local.get_file_info(selector)
    def open_input_file(self, path): return pa.PythonFile(CountingFile(path), mode="r")
    def open_input_stream(self, path): return pa.PythonFile(CountingFile(path), mode="r")
    def create_dir(self, path, recursive): raise NotImplementedError
    def delete_dir(self, path): raise NotImplementedError
    def delete_dir_contents(self, path, missing_dir_ok=False): raise NotImplementedError
    def delete_root_dir_contents(self): raise NotImplementedError
    def delete_file(self, path): raise NotImplementedError
    def move(self, src, dest): raise NotImplementedError
    def copy_file(self, src, dest): raise NotImplementedError
    def open_output_stream(self, path, metadata): raise NotImplementedError
    def open_append_stream(self, path, metadata): raise NotImplementedError
'''


@pytest.fixture
def counted(spark, tmp_path):
    """A file system only known by its factory, which counts the bytes that are read."""
    log = tmp_path / "reads"
    log.mkdir()
    module = f"counting_{os.path.basename(tmp_path).replace('-', '_')}"
    (tmp_path / f"{module}.py").write_text(HANDLER.format(log=str(log)) + "\n" + COUNTING.replace("from fsspec_like import CountingHandler\n", ""))
    spark.sparkContext.addPyFile(str(tmp_path / f"{module}.py"))

    def total(name):
        lines = [line.split() for f in log.iterdir() for line in f.read_text().splitlines()]
        return sum(int(n) for file, n in lines if file == name), len({f for f in log.iterdir() if name in f.read_text()})

    return f"{module}:make", total


def table_of(rows, wide=200):
    return pa.table(
        {
            "id": pa.array(range(rows), pa.int64()),
            "wide": pa.array([f"{i:06d}" * (wide // 6) for i in range(rows)]),
            "kind": pa.array(["a" if i < rows // 2 else None for i in range(rows)]),
        }
    )


def write(path, table, layout="stream", batch=100):
    opener = pa.ipc.new_stream if layout == "stream" else pa.ipc.new_file
    with pa.OSFile(str(path), "wb") as sink, opener(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=batch)


@pytest.mark.parametrize("layout", ["stream", "file"])
def test_a_remote_shard_is_shared_by_byte_range(spark, tmp_path, counted, layout):
    factory, total = counted
    write(tmp_path / "big.arrow", table_of(20_000), layout)
    size = os.path.getsize(tmp_path / "big.arrow")
    df = tables.read_arrow(spark, f"counted://{tmp_path}/big.arrow", filesystem=factory, split_bytes=str(size // 8), provenance="true")
    assert df.rdd.getNumPartitions() in (8, 9)
    rows = df.select("id", "row_index", F.spark_partition_id().alias("part")).collect()
    assert sorted((r.id, r.row_index) for r in rows) == [(i, i) for i in range(20_000)]
    assert len({r.part for r in rows}) >= 7
    read, _ = total("big.arrow")
    assert read < 3 * size  # bodies once, headers of the batches before a range, no task the whole shard


def test_columns_of_a_remote_file_are_read_alone(spark, tmp_path, counted):
    factory, total = counted
    write(tmp_path / "f.arrow", table_of(20_000, wide=2000), "file", batch=2000)
    df = tables.read_arrow(spark, f"counted://{tmp_path}/f.arrow", filesystem=factory, columns="id")
    assert df.agg(F.sum("id")).first()[0] == sum(range(20_000))
    assert total("f.arrow")[0] < os.path.getsize(tmp_path / "f.arrow") / 10


@pytest.mark.parametrize("layout", ["stream", "file"])
@pytest.mark.parametrize("indexed", [False, True])
def test_batches_that_cannot_match_are_not_read(spark, tmp_path, counted, layout, indexed):
    factory, total = counted
    rows = spark.range(20_000).selectExpr("id", "repeat(cast(id AS string), 40) AS wide", "'s.arrow' AS shard")
    folder = tmp_path / "shards"
    if indexed:  # a shard of another tool, without notes
        folder.mkdir()
        write(folder / "s.arrow", table_of(20_000), layout)
        made = index_shards(spark, str(folder), ["id", "kind"]).first()
        assert (made.batches, made.rows) == (200, 20_000)
    else:
        sinks.write_shards(rows, str(folder), order_by="id", layout=layout, batch_rows="100")
    size = os.path.getsize(folder / "s.arrow")

    def where(*conditions):
        return tables.read_arrow(spark, f"counted://{folder}/s.arrow", where=conditions, filesystem=factory)

    assert sorted(r.id for r in where(("id", ">=", 350), ("id", "<", 421)).collect()) == list(range(350, 421))
    assert total("s.arrow")[0] < size / 2
    before = total("s.arrow")[0]
    assert where(("id", "in", [3, 19999, 50_000])).count() == 2 and where(("id", "=", -5)).count() == 0
    assert total("s.arrow")[0] < before + size / 2
    whole = where()
    assert whole.filter("id < 10").union(whole).count() == 20_010 and whole.count() == 20_000
    if indexed:
        assert where(("kind", "null", None)).count() == 10_000 and where(("kind", "=", "a")).count() == 10_000
        write(folder / "s.arrow", table_of(500), layout)  # the index is out of date now
        assert tables.read_arrow(spark, str(folder), where=[("id", ">", 490)]).count() == 9


def test_what_may_match(spark, tmp_path):
    stats = {"a": [3, 9, 0], "n": [None, None, 4], "s": ["b", "d", 1]}
    cases = [
        (("a", "=", 2), False), (("a", "=", 3), True), (("a", ">", 9), False), (("a", "<=", 2), False), (("a", "<", 4), True),
        (("a", "in", [1, 2]), False), (("a", "in", [None, 5]), True), (("a", "null", None), False), (("s", "null", None), True),
        (("n", "not null", None), False), (("n", "=", 1), False), (("s", "=", "e"), False), (("s", "=", 1), True),
        (("x", "=", 1), True), (("a", ">=", 9), True),
    ]
    assert [may_match(f, stats, 4) for f, _ in cases] == [expected for _, expected in cases]
    batch = pa.record_batch({"f": [1.0, float("nan")], "t": ["x" * 100, "y"], "i": [None, 5], "l": [[1], [2]]})
    assert statistics(batch) == {"f": [None, None, 0], "t": [None, None, 0], "i": [5, 5, 1]}
    write(tmp_path / "m.arrow", table_of(10))
    with pytest.raises(Exception, match="like"):
        tables.read_arrow(spark, str(tmp_path), where=[("id", "like", "x")]).count()


@pytest.mark.parametrize("layout", ["stream", "file"])
def test_dictionaries_and_cut_shards(spark, tmp_path, layout):
    table = pa.table({"k": pc.dictionary_encode(pa.array([f"k{i % 7}" for i in range(1000)])), "i": pa.array(range(1000))})
    write(tmp_path / "d.arrow", table, layout, batch=50)
    df = tables.read_arrow(spark, str(tmp_path / "d.arrow"), split_bytes="4000")
    assert sorted((r.i, r.k) for r in df.collect()) == [(i, f"k{i % 7}") for i in range(1000)]
    data = (tmp_path / "d.arrow").read_bytes()
    (tmp_path / "d.arrow").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut off"):
        df.count()
    (tmp_path / "n.arrow").write_bytes(b"no shard at all")
    with pytest.raises(Exception):
        tables.read_arrow(spark, str(tmp_path / "n.arrow")).count()


def test_headers_of_a_stream_without_rows(tmp_path):
    write(tmp_path / "e.arrow", table_of(0))
    with pa.memory_map(str(tmp_path / "e.arrow")) as source:
        assert list(Shard(source, os.path.getsize(tmp_path / "e.arrow")).headers()) == []


@pytest.mark.parametrize("layout", ["stream", "file"])
def test_shards_are_written_under_their_names(spark, tmp_path, layout):
    path = str(tmp_path / "out")
    rows = spark.range(5000).selectExpr("id", "concat('p', id % 7, '.arrow') AS shard", "if(id % 3 = 0, null, cast(id AS string)) AS texto")
    sinks.write_shards(rows, path, order_by="id", layout=layout, batch_rows="64")
    assert sorted(os.listdir(path)) == ["_aside", "commits", *[f"p{i}.arrow" for i in range(7)]]
    assert os.listdir(f"{path}/_aside") == []
    back = tables.read_arrow(spark, path, provenance="true")
    found = sorted((r.id, r.texto, os.path.basename(r.shard_path), r.row_index) for r in back.collect())
    assert found == [(i, None if i % 3 == 0 else str(i), f"p{i % 7}.arrow", i // 7) for i in range(5000)]
    log = {r.name: (r.length, r.n_rows) for r in tables.read_commits(spark, path).collect()}
    assert log == {f"p{i}.arrow": (os.path.getsize(f"{path}/p{i}.arrow"), len(range(i, 5000, 7))) for i in range(7)}
    with pytest.raises(Exception, match="already there"):
        sinks.write_shards(rows, path, order_by="id")
    sinks.write_shards(rows.filter("id < 70"), path, order_by="id", mode="overwrite")
    assert tables.read_arrow(spark, path).count() == 70


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    boom = F.udf(lambda i: 1 // (i - 4000), "long").asNondeterministic()
    rows = spark.range(5000).select("id", F.concat(F.lit("p"), F.col("id") % 3, F.lit(".arrow")).alias("shard"))
    for broken in (rows.withColumn("x", boom("id")), rows.withColumn("shard", F.lit(None).cast("string"))):
        with pytest.raises(Exception):
            sinks.write_shards(broken, path)
    spark.dataSource.register(ArrowShards)
    with pytest.raises(Exception, match="several tasks"):
        rows.repartition(4).sortWithinPartitions("shard").write.format("arrow_ipc").mode("append").save(path)
    with pytest.raises(Exception, match="not together"):
        rows.coalesce(1).write.format("arrow_ipc").mode("append").save(path)
    left = [f for folder, _, files in os.walk(path) for f in files]
    assert left == []


def test_a_cut_shard_is_pending_again(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).selectExpr("id", "concat('p', id % 4, '.arrow') AS shard")
    sinks.write_shards(rows.filter("id % 4 < 3"), path)
    data = (tmp_path / "out" / "p1.arrow").read_bytes()
    (tmp_path / "out" / "p1.arrow").write_bytes(data[:-20])
    (tmp_path / "out" / "p3.arrow").write_bytes(data)  # half-written by something else: without an entry

    def pending():
        done = completed_shards(tables.list_shards(spark, path, "*.arrow"), tables.read_commits(spark, path))
        return sorted(r.name for r in pending_shards(rows.selectExpr("shard AS name").distinct(), done, "name").collect())

    assert pending() == ["p1.arrow", "p3.arrow"]
    os.utime(tmp_path / "out" / "p2.arrow", (1, 1))
    assert pending() == ["p1.arrow", "p2.arrow", "p3.arrow"]
    log = [json.loads(line) for f in (tmp_path / "out" / "commits").glob("*.json") for line in f.read_text().splitlines()]
    assert sum(e["n_rows"] for e in log) == 75


def test_local_files_are_mapped(tmp_path):
    assert isinstance(pafs.LocalFileSystem(), pafs.FileSystem)
    write(tmp_path / "m.arrow", table_of(10))
    with pa.memory_map(str(tmp_path / "m.arrow")) as source:
        shard = Shard(source, os.path.getsize(tmp_path / "m.arrow"))
        (_, header), = shard.headers()
        assert shard.batch(header, ["id"]).column("id").to_pylist() == list(range(10))
