"""Domain and use-case labels: parsing, tags and their distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribado.functions.fixed import ALL_DATASETS, CUT_TAG, EXCLUDED_FROM_ALL, TOP_DOMAINS, TOP_USE_CASES
from cribado.functions.plan import with_column_once
from cribado.functions.responses import domain_list, null_if_no_match, use_case_list
from cribado.functions.text import strip
from cribado.session import materialize

DOMAIN = "domain"
USE_CASE = "use_case"


def parse_labels(df: DataFrame, response_col: str = "response", hyphen_tags: bool = False) -> DataFrame:
    """Replace the response by `domains` and `use_cases`: both lists or neither; no row drops out.

    By default a tag ends at a hyphen, which cuts the tag and the rest of its list.
    `hyphen_tags` keeps hyphens in tags.
    """
    response = F.col(response_col)
    found = df.withColumns(
        {"domains": domain_list(response, hyphen_tags), "use_cases": use_case_list(response, hyphen_tags)}
    ).drop(response_col)
    both = F.col("domains").isNotNull() & F.col("use_cases").isNotNull()
    return found.withColumns(
        {"domains": F.when(both, F.col("domains")), "use_cases": F.when(both, F.col("use_cases"))}
    )


def normalize_labels(df: DataFrame) -> DataFrame:
    """The sentinel for "no match" becomes NULL in either field."""
    return df.withColumns({name: null_if_no_match(F.col(name)) for name in ("domains", "use_cases")})


def explode_tags(normalized: DataFrame, *keep: str) -> DataFrame:
    """One row `(…keep, kind, pos, tag)` per list item; repeats within a list stay."""
    lists = F.array(
        F.struct(F.lit(DOMAIN).alias("kind"), F.col("domains").alias("list")),
        F.struct(F.lit(USE_CASE).alias("kind"), F.col("use_cases").alias("list")),
    )
    fields = normalized.select(*keep, F.explode(lists).alias("_field"))
    filled = fields.filter(F.col("_field.list") != "")
    items = filled.select(*keep, "_field.kind", F.posexplode(F.split("_field.list", ",")).alias("pos", "tag"))
    return with_column_once(items, "tag", strip(F.col("tag")))


def _groups(dataset: Column, in_all: Column) -> Column:
    """The dataset itself and, unless it is left out there, the combined group."""
    return F.explode(F.when(in_all, F.array(dataset, F.lit(ALL_DATASETS))).otherwise(F.array(dataset)))


def _in_all(path: Column) -> Column:
    return ~F.contains(path, F.lit(EXCLUDED_FROM_ALL))


def coverage_counts(normalized: DataFrame, path_col: str = "dataset") -> DataFrame:
    """Records and valid records per dataset and combined; valid ones have both fields."""
    valid = F.col("domains").isNotNull() & F.col("use_cases").isNotNull()
    per_dataset = normalized.groupBy("dataset", _in_all(F.col(path_col)).alias("_in_all")).agg(
        F.count("*").alias("_total"), F.count_if(valid).alias("_valid")
    )
    groups = per_dataset.select(_groups(F.col("dataset"), F.col("_in_all")).alias("dataset"), "_total", "_valid")
    return groups.groupBy("dataset").agg(F.sum("_total").alias("n_total"), F.sum("_valid").alias("n_valid"))


FIRST_COUNTS = "dataset string, in_all boolean, kind string, tag string, n long, place decimal(38,0)"


def placed_tags(normalized: DataFrame, id_col: str, path_col: str = "dataset", drop_cut_tag: bool = True) -> DataFrame:
    """`(dataset, in_all, kind, tag, place)` per list item; `place` puts id and position into one number.

    Ids are whole numbers. A hash aggregate can keep the minimum of a number, but for the minimum of a struct Spark
    would sort all tags first.
    """
    tags = explode_tags(
        normalized.select("dataset", _in_all(F.col(path_col)).alias("in_all"), F.col(id_col).alias("number"), "domains", "use_cases"),
        "dataset",
        "in_all",
        "number",
    )
    if drop_cut_tag:
        tags = tags.filter(F.col("tag") != CUT_TAG)
    place = F.col("number").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("pos")
    return tags.select("dataset", "in_all", "kind", "tag", place.cast("decimal(38,0)").alias("place"))


def first_counts(tags: DataFrame) -> DataFrame:
    """Occurrences and first place per `(dataset, in_all, kind, tag)`; also as a stream, which keeps them as state."""
    return tags.groupBy("dataset", "in_all", "kind", "tag").agg(F.count("*").alias("n"), F.min("place").alias("place"))


def grouped_counts(counts: DataFrame, per_dataset: bool = True, combined: bool = True) -> DataFrame:
    """`(dataset, kind, tag, n, first_seen)` of the datasets and of all together, added up from `first_counts`."""
    if not combined:  # a dataset with paths on both sides of the exclusion is still one dataset
        counts = counts.groupBy("dataset", "kind", "tag").agg(F.sum("n").alias("n"), F.min("place").alias("place"))
    counts = counts.withColumn("first_seen", F.struct("dataset", F.col("place").alias("_place"))).drop("place")
    if not combined:
        return counts
    if per_dataset:
        group = _groups(F.col("dataset"), F.col("in_all"))
    else:
        counts, group = counts.filter("in_all"), F.lit(ALL_DATASETS)
    groups = counts.select(group.alias("dataset"), "kind", "tag", "n", "first_seen")
    return groups.groupBy("dataset", "kind", "tag").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))


def tag_counts(
    normalized: DataFrame,
    id_col: str,
    path_col: str = "dataset",
    per_dataset: bool = True,
    combined: bool = True,
    drop_cut_tag: bool = True,
) -> DataFrame:
    """Occurrences `n` and first position `first_seen` per `(dataset, kind, tag)`.

    The combined group is added up from the counts of the datasets, so the tags themselves are
    read and shuffled once. A dataset that is also kept under a filtered name is left out of it.
    """
    return grouped_counts(first_counts(placed_tags(normalized, id_col, path_col, drop_cut_tag)), per_dataset, combined)


def top_tags(counts: DataFrame, top_domains: int = TOP_DOMAINS, top_use_cases: int = TOP_USE_CASES) -> DataFrame:
    """Most frequent tags per dataset and kind: `(dataset, kind, tag, n, pct, rank)`.

    `pct` is the share of all occurrences, also of tags beyond the top ones. Ties keep the order
    in which the tags were first seen.

    Each group's total joins its tags as one more row that sorts first. So the ranking needs no
    second pass and no join, and Spark cuts every group down to its top rows before the shuffle
    (WindowGroupLimit), however many different tags a model has made up.
    """
    rows = counts.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("_total"))
    rows = rows.groupBy(
        "dataset", "kind", "_total", F.when(~F.col("_total"), F.col("tag")).alias("tag")
    ).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    order = Window.partitionBy("dataset", "kind").orderBy(F.desc("_total"), F.desc("n"), "first_seen", "tag")
    rank = F.col("rank")
    limit = F.when(F.col("kind") == DOMAIN, F.lit(top_domains)).otherwise(F.lit(top_use_cases))
    ranked = (
        rows.withColumn("rank", F.row_number().over(order))
        .filter(rank <= max(top_domains, top_use_cases) + 1)
        .filter(rank <= limit + 1)
    )
    whole = F.max(F.when(F.col("_total"), F.col("n"))).over(Window.partitionBy("dataset", "kind"))
    shares = ranked.withColumn("pct", F.col("n") * 100.0 / whole).filter(~F.col("_total"))
    return shares.select("dataset", "kind", "tag", "n", "pct", (rank - 1).alias("rank"))


def taxonomy_gaps(counts: DataFrame, taxonomy: DataFrame, min_count: int = 1) -> DataFrame:
    """Entries of the caller's taxonomy `(kind, tag)` that a dataset has fewer than `min_count` times.

    One row `(dataset, kind, tag, n)` per gap; `n` is 0 for entries never met.
    """
    datasets = counts.select("dataset").distinct()
    entries = F.collect_set(F.struct("kind", "tag")).alias("entries")
    wanted = datasets.crossJoin(taxonomy.agg(entries)).select("dataset", F.inline("entries"))
    met = wanted.join(counts.select("dataset", "kind", "tag", "n"), ["dataset", "kind", "tag"], "left")
    return met.withColumn("n", F.coalesce("n", F.lit(0)).cast("long")).filter(F.col("n") < min_count)


def unknown_tags(counts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Tags that the caller's taxonomy `(kind, tag)` does not have: `(dataset, kind, tag, n)`."""
    known = taxonomy.select("kind", "tag").distinct()
    return counts.select("dataset", "kind", "tag", "n").join(known, ["kind", "tag"], "left_anti").select("dataset", "kind", "tag", "n")


def _shares(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("dataset", "kind").agg(F.sum("n").alias("_total"))
    return counts.join(totals, ["dataset", "kind"]).withColumn("pct", F.col("n") * 100.0 / F.col("_total"))


def all_tags(counts: DataFrame) -> DataFrame:
    """All tags with their shares, most frequent first: `(dataset, kind, tag, n, pct)`.

    Sorted by range, not ranked in one task per group. `counts` is used twice: store it first
    if it is costly.
    """
    return _shares(counts).orderBy("dataset", "kind", F.desc("n"), "first_seen", "tag").select("dataset", "kind", "tag", "n", "pct")


def ranked_tags(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """All tags with their shares and ranks: `(dataset, kind, tag, n, pct, rank)`, ties in the order they were first seen.

    No task sorts a whole group. The tags are dealt out in ranges of the wanted order and stored; a row's rank is its place
    within its range and group, plus the rows that the group has in earlier ranges. Only these counts, one per
    range and group that meet, are added up along a group.
    """
    spark = counts.sparkSession
    order = [F.col("dataset"), F.col("kind"), F.desc("n"), F.col("first_seen"), F.col("tag")]
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _shares(counts).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = materialize(dealt.select("dataset", "kind", "tag", "n", "pct", F.monotonically_increasing_id().alias("at")))
    stored = stored.withColumn("range", F.shiftright("at", 33))
    # Within a range a group's rows follow each other: the distance to its first row is the place.
    met = stored.groupBy("dataset", "kind", "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    earlier = Window.partitionBy("dataset", "kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    met = met.select(F.col("dataset").alias("met_dataset"), F.col("kind").alias("met_kind"), F.col("range").alias("met_range"), "first", "before")
    same = F.col("dataset").eqNullSafe(F.col("met_dataset")) & (F.col("kind") == F.col("met_kind")) & (F.col("range") == F.col("met_range"))
    rank = (F.col("before") + F.col("at") - F.col("first") + 1).cast("long")
    return stored.join(met, same).select("dataset", "kind", "tag", "n", "pct", rank.alias("rank"))
