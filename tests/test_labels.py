from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cribado.operators import labels
from cribado.streaming.label_counts import count_new_labels, current_counts

SCHEMA = "dataset string, id bigint, domains string, use_cases string"


def top(df, **options):
    rows = labels.top_tags(df, **options).orderBy("dataset", "kind", "rank").collect()
    return [(r.dataset, r.kind, r.tag, r.n, round(r.pct, 2), r.rank) for r in rows]


def test_ties_keep_first_seen_order(spark):
    rows = [("a", 0, "x,y,y,z", "u"), ("a", 1, "z, E ,x", None)]
    counts = labels.tag_counts(spark.createDataFrame(rows, SCHEMA), "id", combined=False)
    assert top(counts) == [
        ("a", "domain", "x", 2, 33.33, 1),
        ("a", "domain", "y", 2, 33.33, 2),
        ("a", "domain", "z", 2, 33.33, 3),
        ("a", "use_case", "u", 1, 100.0, 1),
    ]


def test_cut_tag_can_stay(spark):
    df = spark.createDataFrame([("a", 0, "E", "E")], SCHEMA)
    assert top(labels.tag_counts(df, "id")) == []
    assert len(top(labels.tag_counts(df, "id", drop_cut_tag=False))) == 4


def test_share_is_of_all_occurrences_not_of_the_top(spark):
    df = spark.createDataFrame([("a", 0, "p,p,q,r", None)], SCHEMA)
    counts = labels.tag_counts(df, "id", combined=False)
    assert top(counts, top_domains=1) == [("a", "domain", "p", 2, 50.0, 1)]


def test_filtered_copies_are_left_out_of_the_combined_report(spark):
    rows = [("b", 5, "x", "u"), ("b-toxicity", 5, "x", "u"), ("a", 9, "y", "u")]
    df = spark.createDataFrame(rows, SCHEMA)
    combined = [r for r in top(labels.tag_counts(df, "id")) if r[0] == "All-Datasets"]
    # "a" comes before "b" as a dataset, although its id is higher.
    assert combined == [
        ("All-Datasets", "domain", "y", 1, 50.0, 1),
        ("All-Datasets", "domain", "x", 1, 50.0, 2),
        ("All-Datasets", "use_case", "u", 2, 100.0, 1),
    ]
    only = labels.tag_counts(df, "id", per_dataset=False)
    assert top(only) == combined
    coverage = {r.dataset: (r.n_total, r.n_valid) for r in labels.coverage_counts(df).collect()}
    assert coverage == {"a": (1, 1), "b": (1, 1), "b-toxicity": (1, 1), "All-Datasets": (2, 2)}


def test_exclusion_goes_by_path(spark):
    df = spark.createDataFrame([("b", 1, "x", "u")], SCHEMA).withColumn("path", F.lit("/toxicity/b.json"))
    assert {r[0] for r in top(labels.tag_counts(df, "id", path_col="path"))} == {"b"}
    assert [r.dataset for r in labels.coverage_counts(df, "path").collect()] == ["b"]


def test_one_field_is_enough_for_tags_but_not_for_validity(spark):
    df = labels.normalize_labels(
        spark.createDataFrame([("a", 0, "x", "Sin coincidencia"), ("a", 1, "Sin coincidencia,x", "u"), ("a", 2, None, "")], SCHEMA)
    )
    coverage = labels.coverage_counts(df).filter("dataset = 'a'").first()
    assert (coverage.n_total, coverage.n_valid) == (3, 1)
    tags = [(r.id, r.kind, r.pos, r.tag) for r in labels.explode_tags(df, "id").orderBy("id", "kind", "pos").collect()]
    assert tags == [
        (0, "domain", 0, "x"),
        (1, "domain", 0, "Sin coincidencia"),
        (1, "domain", 1, "x"),
        (1, "use_case", 0, "u"),
    ]


def test_empty_input_gives_an_empty_report(spark):
    assert top(labels.tag_counts(spark.createDataFrame([], SCHEMA), "id")) == []


def brute_force(rows, limits):
    """The report by plain counting in order."""
    groups = {}
    for dataset, _, domains, use_cases in sorted(rows, key=lambda r: (r[0], r[1])):
        for group in [dataset] + ([] if "toxicity" in dataset else ["All-Datasets"]):
            for kind, value in (("domain", domains), ("use_case", use_cases)):
                if value:
                    groups.setdefault((group, kind), []).extend(t.strip() for t in value.split(","))
    report = []
    for (group, kind), tags in sorted(groups.items()):
        counts = Counter(t for t in tags if t != "E")
        ranked = sorted(counts.items(), key=lambda item: item[1], reverse=True)[: limits[kind]]
        total = sum(counts.values())
        report += [(group, kind, t, n, round(n / total * 100, 2), i + 1) for i, (t, n) in enumerate(ranked)]
    return report


_LISTS = st.one_of(st.none(), st.lists(st.sampled_from(["a", " b", "c\n", "d", "E", "f g"]), min_size=1, max_size=5).map(",".join))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["p", "q", "q-toxicity"]), _LISTS, _LISTS), min_size=1, max_size=40))
def test_report_equals_plain_counting(spark, rows):
    rows = [(dataset, i, d, u) for i, (dataset, d, u) in enumerate(rows)]
    limits = {"domain": 2, "use_case": 4}
    counts = labels.tag_counts(spark.createDataFrame(rows, SCHEMA).repartition(5), "id")
    assert top(counts, top_domains=2, top_use_cases=4) == brute_force(rows, limits)


def test_all_tags_sum_to_a_hundred(spark):
    rows = [("a", i, ",".join(f"t{j}" for j in range(i % 7 + 1)), None) for i in range(50)]
    shares = labels.all_tags(labels.tag_counts(spark.createDataFrame(rows, SCHEMA), "id"))
    sums = shares.groupBy("dataset", "kind").agg(F.sum("pct").alias("s"), F.count("*").alias("k")).collect()
    assert all(abs(row.s - 100) < 1e-9 and row.k == 7 for row in sums) and len(sums) == 2
    ranked = [r.n for r in shares.collect() if r.dataset == "a"]
    assert ranked == sorted(ranked, reverse=True)


def test_plan_cuts_groups_before_the_shuffle_and_hashes_the_tags(spark):
    df = spark.createDataFrame([("a", 0, "x", "u")], SCHEMA)
    counts = labels.tag_counts(df, "id", combined=False)
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    plan = labels.top_tags(counts)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("row_number(), 21, Partial")
    assert plan.index("row_number(), 21, Final") < partial


def test_a_dataset_on_both_sides_of_the_exclusion_is_one_dataset(spark):
    rows = [("d", "d/a", 1), ("d", "d/a-toxicity", 2), ("d", "d/a", 3)]
    rows = [(*r, "DOMINIO: Salud\nCASOS DE USO: x") for r in rows]
    df = labels.parse_labels(spark.createDataFrame(rows, "dataset string, path string, id bigint, response string"))
    shares = labels.all_tags(labels.tag_counts(df, "id", "path", combined=False))
    assert sorted((r.kind, r.tag, r.n, r.pct) for r in shares.collect()) == [("domain", "Salud", 3, 100.0), ("use_case", "x", 3, 100.0)]
    both = labels.top_tags(labels.tag_counts(df, "id", "path")).filter("kind = 'domain'")
    assert {r.dataset: r.n for r in both.collect()} == {"d": 3, "All-Datasets": 2}


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_ranks_by_ranges_equal_a_full_sort(spark, ranges):
    rows = [(f"d{i % 3}" if i % 7 else "hot", ("domain", "use_case")[i % 2], f"t{i}", i * i % 11, i) for i in range(600)]
    df = spark.createDataFrame(rows, "dataset string, kind string, tag string, n long, place int")
    counts = df.select("dataset", "kind", "tag", "n", F.struct("dataset", "place").alias("first_seen"))
    found = {(r.dataset, r.kind, r.tag): (r["rank"], r.pct) for r in labels.ranked_tags(counts, ranges).collect()}
    groups: dict = {}
    for dataset, kind, tag, n, place in rows:
        groups.setdefault((dataset, kind), []).append((-n, place, tag))
    assert len(found) == 600
    for (dataset, kind), members in groups.items():
        total = -sum(m[0] for m in members)
        for rank, (n, _, tag) in enumerate(sorted(members), 1):
            assert found[dataset, kind, tag] == (rank, pytest.approx(-n * 100.0 / total))
    assert labels.ranked_tags(counts.limit(0), ranges).count() == 0


def test_counts_grow_with_the_shards(spark, tmp_path):
    source, counts, progress = (str(tmp_path / name) for name in ("in", "counts", "progress"))
    schema = "id long, dataset string, domains string, use_cases string"
    rows = [(i, ("a", "b", "b-toxicity")[i % 3], f"Uno, t{i % 5}", None if i % 4 == 0 else "x, E") for i in range(90)]
    whole = spark.createDataFrame(rows, schema)

    def report(df):
        return sorted(map(tuple, df.collect()), key=repr)

    for part in ("id >= 30 AND id < 60", "id < 30", "false", "id >= 60"):  # places move forward and back
        whole.filter(part).repartition(2).write.mode("append").parquet(source)
        count_new_labels(spark, source, whole.schema, lambda df: df, counts, progress, max_files_per_batch=1)
        count_new_labels(spark, source, whole.schema, lambda df: df, counts, progress)  # nothing is new
        so_far = spark.read.parquet(source)
        for options in ({}, {"combined": False}, {"per_dataset": False}):
            assert report(current_counts(spark, counts, **options)) == report(labels.tag_counts(so_far, "id", **options))
    batches = sorted((tmp_path / "counts").glob("batch=*"))
    last = spark.read.parquet(str(batches[-1]))
    last.write.mode("append").parquet(counts + "/batch=-1")  # an older entry changes nothing
    assert report(current_counts(spark, counts)) == report(labels.tag_counts(whole, "id"))
