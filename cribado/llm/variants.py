"""Spelling variants by a dictionary of trie-node pairs.

The distinct words form a trie, and so do the words read backwards. Every node of both gets a number. A word cut at
some place is a pair (node of what stands before, node of what stands after): with the letter at the place skipped, or
with nothing skipped. Two words that differ in one replaced letter have the same pair with this letter skipped; a
word and the same with one more letter have the same pair, one with nothing skipped. Equal pairs mean equal letters
on both sides, so the neighbours are exact and only whole numbers are joined.

Nodes are numbered over ranges of the sorted words: a node is new where a word parts from the word before it. Only nodes
on the way to the first word of a range can reach into it from earlier ranges; these few get their numbers ahead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribado.session import materialize

#: Fixed value: the letters of a word.
LETTER = r"A-Za-zÀ-ÿ"
#: Expected words of one range of a sorted dictionary.
RANGE_WORDS = 100_000
#: Numbers of nodes and words: the range above, what is counted within it below.
RANGE_BITS = 40

#: What a pair of nodes leaves out: a letter equal to the one before, another letter, nothing.
AGAIN, LETTER_SKIPPED, NOTHING = 0, 1, 2


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, all else unchanged. Most words have no other capitals, so the fast function will do."""
    other_capitals = word.rlike("[À-Þ]")
    folded = F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(other_capitals, folded).otherwise(F.lower(word))


def spoil(doc_id: Column, run: Column, every: int = 31) -> Column:
    """A misspelling in one of `every` distinct runs of a document: one letter goes, all by a checksum."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    check = F.crc32(key.cast("binary"))
    at = (check % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(check % every == 0, cut).otherwise(run)


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, spoiled: bool = False
) -> DataFrame:
    """`word`, `n` of the words of at least `shortest` letters that occur `least` times or more.

    Counts are summed up in every task before words are exchanged. NULL texts have no words.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTER}]{{{shortest},}}"), F.lit(0))
    word = lower_ascii(F.col("run"))
    each = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run")).select("id", word.alias("run"))
    word = spoil(F.col("id"), F.col("run")) if spoiled else F.col("run")
    counted = each.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= least) & (F.length("word") >= shortest))


def _shared(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def _walk(words: list[str], first: tuple[str, list[int]], after: tuple[str, list[int]] | None, base: int) -> Iterator[list[int]]:
    """The node numbers of every prefix, for sorted words that begin with `first` and end before `after`."""
    word, nodes = first
    counter = base
    for new in words:
        kept = _shared(word, new) + 1
        ahead = _shared(new, after[0]) + 1 if after else 0
        nodes = nodes[:kept]
        if ahead > kept:
            nodes += after[1][kept:ahead]
        fresh = len(new) + 1 - len(nodes)
        nodes += range(counter, counter + fresh)
        counter += fresh
        word = new
        yield nodes


def _border_nodes(words: list[str]) -> list[list[int]]:
    """Numbers, from 0 for the root, of the nodes on the way to each of these sorted words."""
    out, counter, last, nodes = [], 1, "", [0]
    for word in words:
        nodes = nodes[: _shared(last, word) + 1]
        fresh = len(word) + 1 - len(nodes)
        nodes = [*nodes, *range(counter, counter + fresh)]
        counter += fresh
        out.append(nodes)
        last = word
    return out


def number_nodes(words: DataFrame, ranges: int) -> DataFrame:
    """`id`, `word`, `nodes` array<long>: for each distinct `word`, the trie nodes of its prefixes from none to whole.

    Other than the words themselves, only the first word of each range passes through the driver. New `id`s, in the order
    of the words, replace those of the input where it has none.
    """
    keep_id = "id" in words.columns
    ranged = materialize(
        words.select(*(["id"] if keep_id else []), "word").repartitionByRange(max(1, ranges), "word").withColumn("range", F.spark_partition_id())
    )
    borders = [tuple(r) for r in ranged.groupBy("range").agg(F.min("word").alias("word")).orderBy("range").collect()]
    numbers = _border_nodes([word for _, word in borders])
    place = {number: i for i, (number, _) in enumerate(borders)}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        number = table.column("range")[0].as_py()
        at, spelled = place[number], table.column("word").to_pylist()
        spelled.sort()
        first = borders[at][1], numbers[at]
        after = (borders[at + 1][1], numbers[at + 1]) if at + 1 < len(borders) else None
        base = (number + 1) << RANGE_BITS
        nodes = pa.array(list(_walk(spelled, first, after, base)), pa.list_(pa.int64()))
        ids = table.column("id") if keep_id else pa.array(range(base, base + len(spelled)), pa.int64())
        return pa.table({"id": ids, "word": pa.array(spelled, pa.string()), "nodes": nodes})

    return ranged.groupBy("range").applyInArrow(run, "id long, word string, nodes array<long>")


def node_pairs(dictionary: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """The numbered words (`id`, `word`, `n`, ids in the order of the words), and all `(before, after, kind, id, n)`."""
    forward = materialize(number_nodes(dictionary, ranges).join(dictionary, "word"))
    backward = number_nodes(forward.select("id", F.reverse("word").alias("word")), ranges)
    both = forward.join(backward.select("id", F.col("nodes").alias("back")), "id")
    length = F.length("word")

    def skipped(i: Column) -> Column:
        same = F.substring("word", i, F.lit(1)) == F.substring("word", i + 1, F.lit(1))
        kind = F.when((i > 0) & same, F.lit(AGAIN)).otherwise(F.lit(LETTER_SKIPPED))
        return F.struct(
            F.get("nodes", i).alias("before"), F.get("back", length - 1 - i).alias("after"), kind.alias("kind")
        )

    def whole(i: Column) -> Column:
        return F.struct(F.get("nodes", i).alias("before"), F.get("back", length - i).alias("after"), F.lit(NOTHING).alias("kind"))

    places = F.sequence(F.lit(0), length)
    letters = F.filter(places, lambda i: i < length)
    cuts = F.concat(F.transform(letters, skipped), F.transform(places, whole))
    pairs = both.select("id", "n", F.explode(cuts).alias("cut")).select("cut.*", "id", "n")
    return forward.select("id", "word", "n"), pairs


def neighbours(pairs: DataFrame) -> DataFrame:
    """`id`, `n_near`, `best` (n, minus id) of the words that have neighbours.

    Words with the same pair and a letter skipped differ in that letter alone, so there are no more of them than letters,
    and one word at most has nothing skipped: a group is bounded by the alphabet. A word that loses either of
    two equal letters becomes the same word; only the first such place counts.
    """
    member = F.struct("n", (-F.col("id")).alias("minus"), "kind")
    groups = pairs.groupBy("before", "after").agg(F.sort_array(F.collect_list(member), asc=False).alias("all"))
    groups = groups.filter(F.size("all") > 1).select(
        F.filter("all", lambda m: m["kind"] != NOTHING).alias("skipped"),
        F.filter("all", lambda m: m["kind"] == LETTER_SKIPPED).alias("first"),
        F.get(F.filter("all", lambda m: m["kind"] == NOTHING), F.lit(0)).alias("whole"),
        F.explode("all").alias("me"),
    )
    me, key = F.col("me"), lambda m: F.when(m.isNotNull(), F.struct(m["n"].alias("n"), m["minus"].alias("minus")))
    others = F.get("skipped", F.when(F.get("skipped", F.lit(0))["minus"] == me["minus"], 1).otherwise(0))
    shorter = F.when(me["kind"] == LETTER_SKIPPED, F.col("whole"))
    longer = F.get("first", F.lit(0))
    nothing = me["kind"] == NOTHING
    near = F.when(nothing, F.size("first")).otherwise(F.size("skipped") - 1 + shorter.isNotNull().cast("int"))
    best = F.when(nothing, key(longer)).otherwise(F.array_max(F.array(key(others), key(shorter))))
    found = groups.select((-me["minus"]).alias("id"), near.cast("long").alias("near"), best.alias("best"))
    return found.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame, longest: int) -> DataFrame:
    """`id`, `root`: where the way along `form` ends. Every round doubles the steps taken; `longest` bounds the way."""
    ways = materialize(forms.select("id", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(longest))) if longest > 1 else 0):
        onward = ways.select(F.col("id").alias("root"), F.col("root").alias("further"))
        ways = materialize(ways.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root")))
    return ways


def group_variants(dictionary: DataFrame, ratio: int = 10, range_words: int = RANGE_WORDS) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` for a table of distinct words (`word`, `n`).

    Near words differ by one inserted, deleted or replaced letter. A word's form is its near word with the largest `n`
    (ties: the first in code-point order) if that is at least `ratio` times its own; else NULL. The root is the end of the
    way along the forms, the word itself without one. As `n` grows by `ratio` with each step, ways are short.

    Rows with NULL as word or count are left out, repeated words are added up, the empty word is near all words
    of one letter; an empty table gives an empty result. Other columns are not read.
    """
    if ratio < 2:
        raise ValueError("a ratio below 2 would let words be each other's form")
    dictionary = materialize(
        dictionary.select("word", F.col("n").cast("long").alias("n")).dropna().groupBy("word").agg(F.sum("n").alias("n"))
    )
    size = dictionary.agg(F.count("*").alias("words"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    words, pairs = node_pairs(dictionary, math.ceil(size.words / range_words))
    near = materialize(neighbours(pairs))
    described = words.join(near, "id", "left").withColumn(
        "form", F.when(F.col("best")["n"] >= ratio * F.col("n"), -F.col("best")["minus"])
    )
    forms = materialize(described.filter("form IS NOT NULL").select("id", "form", F.col("best")["n"].alias("form_n")))
    longest = math.ceil(math.log(max(size.most or 1, 1) / max(size.least or 1, 1), ratio)) + 1
    named = (
        forms.join(_roots(forms, longest), "id")
        .join(words.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
        .join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
        .select("id", "form_n", "form_word", "root_word")
    )
    return (
        words.join(near.select("id", "n_near"), "id", "left")
        .join(named, "id", "left")
        .select(
            "word",
            F.col("form_word").alias("form"),
            F.coalesce("root_word", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            "form_n",
        )
    )


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_variants(count_words(docs, spoiled=True))
