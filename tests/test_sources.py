from __future__ import annotations

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cribado.operators import labels
from cribado.operators.scoring import quantize
from cribado.operators.selection import filter_counts, keep_by_score
from cribado.operators.shards import pending_shards
from cribado.plans import catalog
from cribado.sources import json_results, sinks, tables


def write_shard(path, first, rows, fmt="stream", batch=7, text_type=pa.large_string()):
    table = pa.table(
        {
            "id": pa.array(range(first, first + rows), pa.int64()),
            "texto": pa.array([f"texto ñ {i}" if i % 5 else None for i in range(first, first + rows)], text_type),
        }
    )
    opener = pa.ipc.new_stream if fmt == "stream" else pa.ipc.new_file
    with pa.OSFile(str(path), "wb") as sink, opener(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=batch)


@pytest.mark.parametrize("split_bytes", [None, 500])
def test_arrow_folder(spark, tmp_path, split_bytes):
    write_shard(tmp_path / "a.arrow", 0, 100)
    write_shard(tmp_path / "b.arrow", 100, 50, fmt="file")
    (tmp_path / "notes.txt").write_text("x")
    os.mkdir(tmp_path / "deeper")
    write_shard(tmp_path / "deeper" / "c.arrow", 1000, 5)
    options = {"split_bytes": str(split_bytes)} if split_bytes else {}
    df = tables.read_arrow(spark, str(tmp_path), **options)
    assert df.dtypes == [("id", "bigint"), ("texto", "string")]
    # One task per shard, or several for a shard above the limit.
    assert df.rdd.getNumPartitions() == 2 if not split_bytes else df.rdd.getNumPartitions() > 8
    rows = sorted(df.collect())
    assert [r.id for r in rows] == list(range(150))
    assert rows[0].texto is None and rows[149].texto == "texto ñ 149"
    assert tables.read_arrow(spark, str(tmp_path), recursive="true").count() == 155


def test_arrow_single_file_and_columns(spark, tmp_path):
    write_shard(tmp_path / "a.arrow", 0, 25_000, batch=25_000, text_type=pa.string())
    df = tables.read_arrow(spark, str(tmp_path / "a.arrow"), columns="texto")
    assert df.columns == ["texto"] and df.count() == 25_000
    assert tables.read_arrow(spark, "file://" + str(tmp_path / "a.arrow")).agg(F.sum("id")).first()[0] == sum(range(25_000))


@pytest.mark.parametrize("split_bytes", ["300", "100000"])
def test_manifest_of_datasets_gives_names_and_positions(spark, tmp_path, split_bytes):
    for folder in ("uno_dos", "tres"):
        os.mkdir(tmp_path / folder)
        write_shard(tmp_path / folder / "train.arrow", 1000, 40)
    manifest = tmp_path / "datasets.txt"
    manifest.write_text("\n".join(str(tmp_path / f / "train.arrow") for f in ("uno_dos", "tres")))
    df = tables.read_datasets(spark, str(manifest), columns="id", split_bytes=split_bytes)
    assert df.columns == ["id", "shard_path", "row_index", "dataset"]
    rows = df.collect()
    assert sorted((r.dataset, r.row_index) for r in rows) == sorted((d, i) for d in ("uno-dos", "tres") for i in range(40))
    assert all(r.id == 1000 + r.row_index and r.shard_path.endswith("train.arrow") for r in rows)


def test_shards_with_different_columns_are_an_error(spark, tmp_path):
    write_shard(tmp_path / "a.arrow", 0, 5)
    table = pa.table({"id": pa.array([1])})
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    with pytest.raises(Exception, match="has no column texto"):
        tables.read_arrow(spark, str(tmp_path)).collect()


def test_arrow_without_shards_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no .arrow shards"):
        tables.read_arrow(spark, str(tmp_path)).count()


def test_manifest(spark, tmp_path):
    path = tmp_path / "datasets.txt"
    path.write_text("# list\n/data/a/train.arrow\n\n/data/b/train.arrow\r\n#/data/c\n")
    assert tables.manifest_paths(spark, str(path)) == ["/data/a/train.arrow", "/data/b/train.arrow"]
    path.write_text("# none\n")
    with pytest.raises(ValueError, match="no datasets"):
        tables.manifest_paths(spark, str(path))


def test_template(spark, tmp_path):
    path = tmp_path / "prompt.txt"
    path.write_text("Evalúe:\n\n<EJEMPLO>\n\nPUNTUACIÓN", encoding="utf-8")
    assert tables.read_template(spark, str(path)) == "Evalúe:\n\n<EJEMPLO>\n\nPUNTUACIÓN"


TRICKY = ["línea 1\nlínea 2", 'cita "x" }', "    },\n    }\n}", "", "{", "}}", "tab\t\\ñ", "x" * 5000]


@pytest.mark.parametrize("indent", [4, None, 0])
@pytest.mark.parametrize("size", [0, 1, 2, 400])
@pytest.mark.parametrize("split_bytes", [61, 1 << 20])
def test_rating_results(spark, tmp_path, size, indent, split_bytes):
    if size == 400 and split_bytes == 61 and indent == 4:
        size = 40
    records = {str(i): {"Score": f"{i % 6}.", "Prompt": TRICKY[i % len(TRICKY)]} for i in range(size)}
    text = json.dumps(records, ensure_ascii=bool(indent), indent=indent)
    (tmp_path / "r.json").write_text(text, encoding="utf-8")
    rows = tables.read_ratings(spark, str(tmp_path), split_bytes=max(split_bytes, len(text) // 100)).orderBy("id").collect()
    assert [(r.id, r.score_raw, r.text) for r in rows] == [
        (i, f"{i % 6}.", TRICKY[i % len(TRICKY)]) for i in range(size)
    ]


def test_records_at_every_range(tmp_path):
    """All ways to cut a file into ranges of one size, states taken from what went before."""
    text = json.dumps({"0": {"a": '\\"{', "b": {"c": "}\\\\"}}, "x\\\"": {}, "12": {"é": [{"d": "\\\\\""}, "]"]}}, ensure_ascii=False)
    path = tmp_path / "f.json"
    path.write_text(text, encoding="utf-8")
    size = path.stat().st_size
    expected = [(k, v) for k, v in json.loads(text).items()]
    for step in range(1, size + 1):
        found, in_string, depth = [], False, 0
        for start in range(0, size, step):
            stop = min(start + step, size)
            found += json_results._records(str(path), size, start, stop, in_string, depth)
            quotes, outside, inside = json_results._summary(str(path), start, stop)
            depth += inside if in_string else outside
            in_string ^= quotes % 2 == 1
        assert [(k, json.loads(v)) for k, v in found] == expected
        assert (in_string, depth) == (False, 0)


def test_a_large_file_of_one_line_is_read_by_several_tasks(spark, tmp_path):
    records = {str(i): {"Score": "4", "Prompt": f"texto {i} " * 20} for i in range(3000)}
    (tmp_path / "r.json").write_text(json.dumps(records), encoding="utf-8")
    df = tables.read_ratings(spark, str(tmp_path), split_bytes=50_000)
    parts = df.select("id", F.spark_partition_id().alias("part")).collect()
    assert sorted(r.id for r in parts) == list(range(3000)) and len({r.part for r in parts}) > 5


def test_result_files_are_written_as_others_read_them(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "concat('f', id % 3, '.json') AS name", "if(id % 4 = 0, null, concat('t \"', id)) AS domains", "'u' AS use_cases")
    for indent in (False, True):
        made = sinks.write_result_files(rows, str(tmp_path / str(indent)), "name", "id", indent).collect()
        assert sorted((r.name, r.n_rows) for r in made) == [("f0.json", 17), ("f1.json", 17), ("f2.json", 16)]
        assert sorted(os.listdir(tmp_path / str(indent))) == ["f0.json", "f1.json", "f2.json"]
        for k in range(3):
            found = json.loads((tmp_path / str(indent) / f"f{k}.json").read_text())
            assert list(found) == [str(i) for i in range(k, 50, 3)]
            assert all(v == {"domains": None if int(i) % 4 == 0 else f't "{i}', "use_cases": "u"} for i, v in found.items())


def test_broken_results_are_an_error(spark, tmp_path):
    (tmp_path / "r.json").write_text('{\n    "0": {\n        "Score": "4\n    }\n}')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_ratings(spark, str(tmp_path)).collect()


def test_label_results_carry_their_dataset(spark, tmp_path):
    os.mkdir(tmp_path / "deeper")
    record = {"0": {"domains": "Salud", "use_cases": None}, "1": {"domains": None, "use_cases": None}}
    for folder, name in ((".", "usecasesdomains_a-b_M.json"), ("deeper", "usecasesdomains_c_M.json"), (".", "other.json")):
        (tmp_path / folder / name).write_text(json.dumps(record, indent=4))
    rows = tables.read_labels(spark, str(tmp_path)).collect()
    assert sorted((r.dataset, r.id, r.domains, r.use_cases) for r in rows) == [
        ("a-b", 0, "Salud", None), ("a-b", 1, None, None), ("c", 0, "Salud", None), ("c", 1, None, None)
    ]


def test_report_over_imported_results(spark, tmp_path):
    record = {"0": {"domains": "Salud, Legal", "use_cases": "a"}, "1": {"domains": "Sin coincidencia", "use_cases": "a, E"}}
    for name in ("uno", "dos", "dos-toxicity"):
        (tmp_path / f"usecasesdomains_{name}_M.json").write_text(json.dumps(record, indent=4))
    normalized = labels.normalize_labels(tables.read_labels(spark, str(tmp_path)))
    report = labels.top_tags(labels.tag_counts(normalized, "id", path_col="path")).collect()
    assert {r.dataset for r in report} == {"uno", "dos", "dos-toxicity", "All-Datasets"}
    assert {(r.kind, r.tag, r.n, r.pct, r.rank) for r in report if r.dataset == "All-Datasets"} == {
        ("domain", "Salud", 2, 50.0, 1), ("domain", "Legal", 2, 50.0, 2), ("use_case", "a", 4, 100.0, 1)
    }
    coverage = {r.dataset: (r.n_total, r.n_valid) for r in labels.coverage_counts(normalized, "path").collect()}
    assert coverage["All-Datasets"] == (4, 2) and coverage["dos-toxicity"] == (2, 1)


def test_listing_and_pending(spark, tmp_path):
    for name in ("a.arrow", "b.arrow", "c.txt"):
        (tmp_path / name).write_text("x")
    listed = tables.list_shards(spark, str(tmp_path), "*.arrow")
    names = listed.select(F.element_at(F.split("path", "/"), -1).alias("shard"))
    finished = spark.createDataFrame([("a.arrow", 1)], "shard string, n int")
    assert [r.shard for r in pending_shards(names, finished, "shard").collect()] == ["b.arrow"]
    assert {r.length for r in listed.collect()} == {1}


def test_provenance_and_union(spark, tmp_path):
    one, two = spark.range(3).withColumn("x", F.lit(1)), spark.range(2).select(F.lit(2).alias("x"), "id")
    union = tables.union_shards(one, two)
    assert union.columns == ["id", "x"] and union.count() == 5
    one.write.parquet(str(tmp_path / "p"))
    rows = tables.with_provenance(tables.read_shards(spark, str(tmp_path / "p"))).collect()
    assert {r.row_index for r in rows} <= {0, 1, 2}
    assert all(r.file_name.endswith(".parquet") and r.file_path.endswith(r.file_name) for r in rows) and len(rows) == 3


@pytest.mark.parametrize("parts", [["documents.parquet"], ["documents.parquet/part-0000.parquet", "documents.parquet/part-0001.parquet", "documents.parquet/part-0002"]])
def test_scan_of_a_shard_in_one_file_or_in_parts(spark, tmp_path, parts):
    ids = [[0, 1, 2, 3], [4, None], [6, 6, 8]] if len(parts) > 1 else [[0, 1, 2, 3, 4, None, 6, 6, 8]]
    folder = tmp_path / "with space"
    for part, doc_ids in zip(parts, ids):
        os.makedirs((folder / part).parent, exist_ok=True)
        table = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "text": ["t"] * len(doc_ids), "source": [f"s{i}" if i else None for i in doc_ids]})
        pq.write_table(table, str(folder / part), row_group_size=2)
    pq.write_table(pa.table({"doc_id": [99]}), str(folder / "pages.parquet"))
    df = catalog.scan_with_provenance(spark, str(folder))
    expected = [(i, f"s{i}" if i else None, "documents.parquet", at) for at, i in enumerate([0, 1, 2, 3, 4, None, 6, 6, 8])]
    assert df.columns == ["doc_id", "source", "file_name", "row_index"]
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: r[3]) == expected
    assert "text:string" not in df._jdf.queryExecution().executedPlan().toString()


def test_positions_in_several_shards(spark, tmp_path):
    for name, first, n in (("a.parquet/0.parquet", 0, 3), ("a.parquet/1.parquet", 3, 2), ("b.parquet/0.parquet", 0, 4), ("b.parquet/1.parquet", 4, 1)):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        pq.write_table(pa.table({"id": range(first, first + n)}), str(tmp_path / name))
    rows = tables.with_provenance(tables.read_shards(spark, str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")))
    placed = tables.with_shard_provenance(rows, F.element_at(F.split("file_path", "/"), -2))
    assert placed.columns == rows.columns
    found = sorted((r.file_name, r.row_index, r.id, r.file_path.endswith(f"{r.file_name}/{int(r.id > 2 + (r.file_name > 'b'))}.parquet")) for r in placed.collect())
    assert found == [(s, i, i, True) for s in ("a.parquet", "b.parquet") for i in range(5)]


def test_scored_folder_is_pruned_by_threshold(spark, tmp_path):
    scored = quantize(spark.range(60).select("id", (F.col("id") / 10).alias("score")))
    path = str(tmp_path / "scored")
    sinks.write_scored(scored, path)
    kept = keep_by_score(spark.read.parquet(path), 3)
    assert kept.count() == scored.filter("int_score >= 3").count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(int_score" in plan and "Exchange" not in plan
    counts = [filter_counts(scored, t).first() for t in range(7)]
    assert counts[0].n_before == counts[0].n_after == 60 and counts[6].n_after == 0
    assert all(a.n_after >= b.n_after for a, b in zip(counts, counts[1:]))
    sinks.write_selected(kept, str(tmp_path / "kept"), rows_per_file=5)
    assert max(len(r.ids) for r in _by_file(spark, str(tmp_path / "kept"))) <= 5


def _by_file(spark, path):
    rows = tables.with_provenance(spark.read.parquet(path))
    return rows.groupBy("file_name").agg(F.collect_list("id").alias("ids")).collect()


def test_results_are_appended(spark, tmp_path):
    for fmt in ("parquet", "json"):
        for _ in range(2):
            sinks.write_results(spark.range(3), str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 6
    with pytest.raises(ValueError):
        sinks.write_results(spark.range(3), str(tmp_path / "x"), "csv")


def test_a_truncated_results_file_is_refused(spark, tmp_path):
    records = {str(i): {"Score": "3", "Prompt": f"t{i}"} for i in range(5)}
    text = json.dumps(records, indent=4)
    (tmp_path / "whole.json").write_text(text)
    assert tables.read_ratings(spark, str(tmp_path)).count() == 5
    end = text.index("\n    },\n", text.index('"2"')) + len("\n    },\n")
    (tmp_path / "cut.json").write_text(text[:end])
    with pytest.raises(ValueError, match="cut.json"):
        tables.read_ratings(spark, str(tmp_path))
