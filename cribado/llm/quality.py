"""Quality rules: what a text says about itself, and how often its lines occur in other documents of its host.

Cross-document line frequency: lines are normalised and hashed, the distinct documents that hold a line are
counted per host, lines above the limit are removed, and documents that lose too much are rejected. The limit grows
with the host. Copies of a clean text must not reject each other: exact copies of a text count as one document,
and a document counts for a line only if most of its words stand outside such lines. So a family of near copies,
whose members share nearly all they have, makes none of its lines frequent, however large it is.

Built-in functions only. Counting is by (host, line, text), so neither a frequent line nor a large host meets
in one task. The lines above the limit are sent to all tasks only if their counted number allows it; beyond
that, the lines of all documents are joined with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribado.functions.plan import with_column_once
from cribado.llm.common import WORD, words
from cribado.session import materialize

#: A line in more distinct texts of one host than this, and than this share of the host's texts, is removed.
MAX_TEXTS = 100
HOST_SHARE = 0.001
#: A text counts if at least this percentage of its words stands outside lines that are above the limit.
OWN_PERCENT = 75
#: A document is depleted if less than this share of its words is left.
MIN_LEFT = 0.3
#: Up to so many frequent lines (8 bytes each) are broadcast, as one list per host that every document is held against.
BROADCAST_LINES = 20_000
#: Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50


def _text_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def normal_lines(text: Column) -> Column:
    """Hashes of the lines that hold a word, lower case and with single spaces, in their order."""
    single = F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "))
    return F.transform(_text_lines(single), lambda line: F.xxhash64(F.trim(line)))


def repeated_words(found: Column, hashes: Column) -> Column:
    """Words within 3-word windows that occur twice or more, from the words and the windows' hashes.

    Sorted by (hash, position), a repeated window has a neighbour of its own hash. Of the positions of
    repeated windows in order, each covers three words less those the next one covers too.
    """
    count = F.size(hashes)
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def at(rows: Column, i: Column) -> Column:
        return F.get(rows, i)

    def covered(rows: Column) -> Column:
        twice = F.filter(
            rows,
            lambda row, j: (at(rows, j - 1)["h"] == row["h"]) | F.coalesce(at(rows, j + 1)["h"] == row["h"], F.lit(False)),
        )
        return F.array_sort(F.transform(twice, lambda row: row["i"]))

    def total(places: Column) -> Column:
        widths = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(widths, F.lit(0), lambda a, b: a + b)

    def once(value: Column, f) -> Column:
        """`f(value)` with the value computed a single time."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    all_once = F.size(F.array_distinct(hashes)) == count
    return F.when(all_once, 0).otherwise(once(ordered, lambda rows: once(covered(rows), total))).cast("long")


def _windows(found: Column) -> Column:
    starts = F.when(F.size(found) >= 3, F.slice(found, 1, F.size(found) - 2)).otherwise(F.array().cast("array<string>"))
    return F.transform(starts, lambda w, i: F.xxhash64(w, F.get(found, i + 1), F.get(found, i + 2)))


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add to `docs`, which must not have them, `n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed` in one pass, without a shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    filled = docs.withColumn("found_words", words(F.col(text_col))).withColumn("found_windows", _windows(F.col("found_words")))
    lines = _text_lines(text)
    measured = filled.withColumns(
        {
            "n_words": F.size("found_words").cast("long"),
            "word_chars": F.length(F.array_join("found_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(F.col("found_words"), F.col("found_windows")),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).drop("found_words", "found_windows")


def _keyed(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """`host`, `text_hash` and `row`, a struct of all columns: what is added beside them cannot clash."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("text_hash"), row.alias("row"))


def _above(lines: DataFrame, limits: DataFrame) -> DataFrame:
    """`host`, `line`, `limit` of those of the distinct `(host, line, text_hash)` that are above the limit of their host."""
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("texts"))
    limits = limits.select(F.col("host").alias("limited"), "limit")
    joined = counted.join(limits, F.col("host").eqNullSafe(F.col("limited")))
    return joined.filter(F.col("texts") > F.col("limit")).select("host", "line", "limit")


def frequent_lines(
    keyed: DataFrame, text_col: str, max_texts: int = MAX_TEXTS, host_share: float = HOST_SHARE, own_percent: int = OWN_PERCENT
) -> DataFrame:
    """`host`, `line` (a hash) of the lines that are above the limit in texts that are otherwise of their own.

    First all distinct texts of a host count. Then only those do that have at least `own_percent` of their words
    outside the lines found so.
    """
    text = F.col("row")[text_col]
    sizes = keyed.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("all"))
    limits = materialize(sizes.select("host", F.greatest(F.lit(float(max_texts)), F.lit(host_share) * F.col("all")).alias("limit")))
    lines = keyed.select("host", "text_hash", F.explode(F.array_distinct(normal_lines(text))).alias("line")).distinct()
    often = materialize(_above(lines, limits))
    if often.isEmpty():
        return often.select("host", "line")
    hit = with_hits(keyed, often, text_col).filter(F.size("hits") > 0)
    outside, total = _outside(text, F.col("hits"))
    own = hit.filter(100 * outside >= own_percent * total).select("host", "text_hash", F.explode("hits").alias("line"))
    return materialize(_above(own.distinct(), limits).select("host", "line"))


def with_hits(keyed: DataFrame, frequent: DataFrame, text_col: str) -> DataFrame:
    """Add `hits`: the hashes of a text's lines that are frequent in its host, NULL or empty if it has none."""
    found = normal_lines(F.col("row")[text_col])
    if frequent.count() <= BROADCAST_LINES:
        listed = frequent.groupBy(F.col("host").alias("listed_host")).agg(F.collect_list("line").alias("listed"))
        joined = keyed.join(F.broadcast(listed), F.col("host").eqNullSafe(F.col("listed_host")), "left")
        # Computed once: later expressions mention it within each line.
        return with_column_once(joined, "hits", F.array_intersect(found, F.col("listed"))).select(*keyed.columns, "hits")
    lines = keyed.select("host", "text_hash", F.explode(F.array_distinct(found)).alias("line")).distinct()
    frequent = frequent.select(F.col("host").alias("frequent_host"), F.col("line").alias("frequent_line"))
    same = F.col("host").eqNullSafe(F.col("frequent_host")) & (F.col("line") == F.col("frequent_line"))
    hits = lines.join(frequent, same).groupBy(F.col("host").alias("hit_host"), F.col("text_hash").alias("hit_text"))
    hits = hits.agg(F.collect_list("line").alias("hits"))
    same = F.col("host").eqNullSafe(F.col("hit_host")) & (F.col("text_hash") == F.col("hit_text"))
    return keyed.join(hits, same, "left").select(*keyed.columns, "hits")


def _outside(text: Column, hits: Column) -> tuple[Column, Column]:
    """A text's words outside the lines whose hash is in `hits`, and all its words."""
    sizes = F.transform(_text_lines(text), lambda line: F.size(words(line)))
    left = F.zip_with(normal_lines(text), sizes, lambda h, n: F.when(F.array_contains(hits, h), 0).otherwise(n))
    add = lambda values: F.aggregate(values, F.lit(0), lambda a, b: a + b)
    return add(left), add(sizes)


def without_lines(text: Column, hits: Column) -> Column:
    """The text without the lines whose hash is in `hits`; lines without words stay."""
    hashed = lambda line: F.xxhash64(F.trim(F.lower(F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " "))))
    left = F.filter(F.split(text, "\n"), lambda line: ~(line.rlike(WORD) & F.array_contains(hits, hashed(line))))
    return F.array_join(left, "\n")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
JUDGED = [*MEASURES, "left_share", "kept", "cleaned"]


def _judged(docs: DataFrame, text_col: str, host_col: str, min_left: float, **limits) -> DataFrame:
    """`row` with the columns as they were, and `judged`."""
    keyed = _keyed(docs, text_col, host_col)
    rows = with_hits(keyed, frequent_lines(keyed, text_col, **limits), text_col)
    text, hits = F.col("row")[text_col], F.col("hits")
    any_hit = F.coalesce(F.size(hits) > 0, F.lit(False))
    outside, total = _outside(text, hits)
    measured = base_measures(rows.select("row", "hits", text.alias("text")), "text")
    left = F.when(any_hit, outside / total).otherwise(F.lit(1.0))
    kept = ~F.col("base_failed") & (F.col("left_share") >= min_left)
    cleaned = F.when(any_hit, without_lines(text, hits)).otherwise(text)
    judged = measured.withColumn("left_share", left).withColumn("kept", kept).withColumn("cleaned", cleaned)
    once = with_column_once(judged, "judged", F.struct(*JUDGED))  # a later filter must not repeat all this
    return once.select("row", "judged")


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """All columns of `docs` plus the base measures, `left_share`, `kept` and `cleaned` (text without frequent lines).

    NULL and empty texts have no words and fail the base rules; a NULL host is a host of its own; repeated rows
    are judged each; an empty table stays empty. Ids play no part. Input columns named like an output column are replaced,
    all others stay, whatever their names. `limits` are those of `frequent_lines`.
    """
    found = _judged(docs, text_col, host_col, min_left, **limits)
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in JUDGED), *(f"judged.{c}" for c in JUDGED))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """Documents that pass, without their frequent lines; columns as they were, whatever their names.

    A column `n_chars` follows the text. NULL and empty texts do not pass; repeated rows and NULL ids stay as often as
    they pass; an empty table stays empty.
    """
    found = _judged(docs, text_col, host_col, min_left, **limits).filter("judged.kept")
    made = {text_col: F.col("judged.cleaned")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("judged.cleaned").cast(docs.schema["n_chars"].dataType)
    return found.select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
