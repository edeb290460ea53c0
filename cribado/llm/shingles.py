"""N-gram Jaccard join by vertical partitioning.

1. Every chunk asks how many documents hold each of its shingles. Shingles of one document only cannot be
   shared, so a document whose shared shingles are too few for the threshold is settled.
2. The others keep their shared shingles in the global order, rare ones first. Documents with equal sets
   collapse to one representative.
3. Of two similar sets the first few shingles in this order must meet (prefix filter). Documents that meet are
   first compared with one leader of their meeting place, not with each other: the one that shares the largest
   part of itself, the origin of a family of copies if there is one. Documents linked by whatever way are not
   compared again. Those still apart at a meeting place are compared if their sizes and their overlaps with the
   leader leave it possible that they are similar; so no link is lost.
4. A comparison cuts the global order into fragments, counts the overlap of each pair in each fragment
   by itself, and sums per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.llm import chunks
from cribado.llm.chunks import Chunk, Store
from cribado.llm.components import connected
from cribado.session import materialize

WORDS = 5
#: Similar means 100 * shared >= PERCENT * all.
PERCENT = 80
#: Parts that the global order is cut into.
FRAGMENTS = 4
_KEY_BITS = 48
_SETS = "doc_id long, n_shingles long, set_low long, set_high long, shared array<long>"


def least_shared(n, percent: int = PERCENT):
    """Shingles that a set of n must share with any similar set."""
    return (percent * n + 99) // 100


class Shingles:
    """Distinct (document, shingle) pairs of a chunk, in the order of document and hash."""

    def __init__(self, chunk: Chunk):
        starts, ends, firsts = chunk.words()
        words = chunk.word_hashes(starts, ends, lower=True, seed=2)
        counts = np.diff(firsts)
        places = chunks.window_places(firsts, WORDS)
        hashes = chunks.windows(words, WORDS)[places]
        docs = np.searchsorted(firsts, places, side="right") - 1
        short = np.flatnonzero((counts > 0) & (counts < WORDS))
        whole = [chunks.windows(words[firsts[d] : firsts[d + 1]], int(counts[d]))[0] + np.uint64(counts[d]) for d in short]
        docs = np.concatenate([docs, short])
        hashes = np.concatenate([hashes, chunks.mix64(np.array(whole, np.uint64))])
        order = np.lexsort((hashes, docs))
        docs, hashes = docs[order], hashes[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
        self.docs, self.hashes = docs[new], hashes[new]
        self.sizes = np.bincount(self.docs, minlength=len(chunk.ids))

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return chunks.distinct(self.hashes >> np.uint64(64 - _KEY_BITS))


def _ask(chunk: Chunk, ranges: int):
    keys, counts, _ = Shingles(chunk).keys()
    at = chunks.range_starts(keys, ranges, _KEY_BITS)
    for r in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[r], at[r + 1])
        payload = chunks.pack_parts(chunks.pack_sorted(keys[part]), chunks.pack(counts[part].astype(np.uint32)))
        yield r, chunk.number, payload


def _reply(payloads: list[bytes]) -> list[bytes]:
    """How many documents hold each key, on a scale of 0 (one) to 255 that keeps the order."""
    parts = [chunks.unpack_parts(p, 2) for p in payloads]
    keys = [chunks.unpack_sorted(p[0]) for p in parts]
    counts = np.concatenate([chunks.unpack(p[1], np.uint32) for p in parts])
    _, _, inverse = chunks.distinct(np.concatenate(keys))
    total = np.bincount(inverse, weights=counts)
    scale = np.minimum(255, np.ceil(8 * np.log2(total))).astype(np.uint8)
    return [chunks.pack(s) for s in np.split(scale[inverse], np.cumsum([len(k) for k in keys])[:-1])]


def _sets(chunk: Chunk, answers: list[bytes], percent: int) -> Iterator[tuple]:
    s = Shingles(chunk)
    _, _, inverse = s.keys()
    scale = np.concatenate([chunks.unpack(a, np.uint8) for a in answers])[inverse] if answers else np.zeros(0, np.uint8)
    low = np.zeros(len(chunk.ids), np.uint64)
    high = np.zeros(len(chunk.ids), np.uint64)
    np.add.at(low, s.docs, chunks.mix64(s.hashes ^ np.uint64(0x2545F4914F6CDD1D)))
    np.add.at(high, s.docs, chunks.mix64(s.hashes ^ np.uint64(0x9E6C63D0676A9A99)))
    shared = np.bincount(s.docs, weights=scale > 0, minlength=len(chunk.ids))
    candidate = (s.sizes > 0) & (shared >= least_shared(s.sizes, percent))
    # the global order: (scale, hash); the scale takes the place of the hash's highest bits
    ordered = (s.hashes >> np.uint64(8)) | (scale.astype(np.uint64) << np.uint64(56))
    ordered = (ordered ^ np.uint64(1 << 63)).view(np.int64)  # same order as signed numbers
    ends = np.cumsum(s.sizes)
    for d, number in enumerate(chunk.ids):
        mine = None
        if candidate[d]:
            part = slice(ends[d] - s.sizes[d], ends[d])
            mine = np.sort(ordered[part][scale[part] > 0]).tolist()
        yield number, int(s.sizes[d]), int(low[d : d + 1].view(np.int64)[0]), int(high[d : d + 1].view(np.int64)[0]), mine


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: `doc_id, n_shingles, set_low, set_high, shared`.

    `set_low` and `set_high` stand for the whole set; `shared` are the shingles that other documents have too, in
    the global order, or NULL if they are too few for any link.
    """
    store = Store(docs, id_col, text_col)
    ranges = store.ranges
    asked = store.run(lambda chunk: _ask(chunk, ranges), chunks.ASK_SCHEMA)
    answers = chunks.answer(asked, _reply)
    return materialize(store.run(lambda chunk, given: _sets(chunk, given, percent), _SETS, answers))


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Add `overlap` to the pairs (a, b): partial overlaps are counted per fragment and summed per pair."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("segment").alias("a_part"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("segment").alias("b_part"))
    partial = F.size(F.array_intersect("a_part", "b_part"))
    counted = pairs.join(left, "a").join(right, ["b", "fragment"]).withColumn("partial", partial)
    return counted.groupBy("a", "b", "a_size", "b_size").agg(F.sum("partial").alias("overlap"))


def _similar(counted: DataFrame, percent: int) -> DataFrame:
    union = F.col("a_size") + F.col("b_size") - F.col("overlap")
    return counted.filter(100 * F.col("overlap") >= percent * union).select("a", "b")


def _cut(sets: DataFrame, fragments: int) -> DataFrame:
    """`(node, fragment, segment)`: each set cut where the global order is cut, at quantiles of first, middle and last places."""
    places = [F.get("shared", (F.size("shared") * i / 4).cast("int")) for i in range(4)]
    sampled = sets.select(F.explode(F.array(*places)).alias("s"))
    cuts = sampled.agg(F.percentile_approx("s", [i / fragments for i in range(1, fragments)], 1000)).first()[0] or []
    lows = [-(1 << 63), *sorted(set(cuts))]
    highs = [*lows[1:], None]

    def between(low: int, high: int | None):
        return lambda s: (s >= low) & (s < high) if high is not None else s >= low

    parts = [
        F.struct(F.lit(i).alias("fragment"), F.filter("shared", between(low, high)).alias("segment"))
        for i, (low, high) in enumerate(zip(lows, highs))
    ]
    return sets.select("node", F.inline(F.array(*parts))).filter(F.size("segment") > 0)


def _pairs(left: DataFrame, right: DataFrame, condition, percent: int) -> DataFrame:
    """Distinct pairs of different components that meet and could be similar.

    Two sets that share enough meet at a place from which on both still have as many shareable shingles (`after`) as
    they must share: only there they are a pair. Where both have been compared with the leader of the meeting
    place, they share at most the lesser overlap with it plus the lesser rest.
    """
    columns = ("node", "component", "size", "shareable", "after", "led")
    a = left.select("s", *(F.col(c).alias(f"a_{c}") for c in columns))
    b = right.select("s", *(F.col(c).alias(f"b_{c}") for c in columns))
    needed = percent * (F.col("a_size") + F.col("b_size"))
    most = F.least("a_after", "b_after")
    rest = F.least(F.col("a_shareable") - F.col("a_led"), F.col("b_shareable") - F.col("b_led"))
    by_leader = F.when(F.col("a_led").isNotNull() & F.col("b_led").isNotNull(), F.least("a_led", "b_led") + rest)
    possible = (100 + percent) * F.least(most, by_leader) >= needed
    met = a.join(b, (a["s"] == b["s"]) & condition & (F.col("a_component") != F.col("b_component")) & possible)
    ordered = F.col("a_node") < F.col("b_node")
    return met.select(
        F.least("a_node", "b_node").alias("a"),
        F.greatest("a_node", "b_node").alias("b"),
        F.when(ordered, F.col("a_size")).otherwise(F.col("b_size")).alias("a_size"),
        F.when(ordered, F.col("b_size")).otherwise(F.col("a_size")).alias("b_size"),
    ).distinct()


def _leaders(here: DataFrame) -> DataFrame:
    """Of each meeting place with several components, the set that shares the largest part of itself."""
    alone = (F.col("size") - F.col("shareable")) / F.col("size")
    columns = ["node", "component", "size", "shareable", "after", "led"]
    led = here.groupBy("s").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.min(F.struct(alone, F.xxhash64("node"), *columns)).alias("leader")
    )
    return materialize(led.filter("least <> most").select("s", *(f"leader.{c}" for c in columns)))


def _components(nodes: DataFrame, percent: int, fragments: int) -> DataFrame:
    """`(node, component)` of the linked sets among `nodes` (node, size, shared)."""
    shareable = F.size("shared")
    prefix = shareable - least_shared_column("size", percent) + 1
    meetings = materialize(
        nodes.select(
            "node", "size", shareable.alias("shareable"), F.posexplode(F.slice("shared", F.lit(1), prefix)).alias("place", "s")
        ).select("s", "node", "size", "shareable", (F.col("shareable") - F.col("place")).alias("after"))
    )
    segments = materialize(_cut(nodes, fragments))
    here = meetings.withColumn("component", F.col("node")).withColumn("led", F.lit(None).cast("int"))
    leaders = _leaders(here)
    counted = materialize(_overlaps(_pairs(here, leaders, F.lit(True), percent), segments))
    links = materialize(_similar(counted, percent))
    component = materialize(connected(links))

    # What is still apart at a meeting place, with its overlap with the leader there.
    both = counted.select("a", "b", "overlap").union(counted.select("b", "a", "overlap"))
    both = both.toDF("leader", "node", "overlap")
    here = meetings.join(leaders.select("s", F.col("node").alias("leader")), "s")
    here = here.join(both, ["leader", "node"], "left").join(component, "node", "left")
    here = here.withColumn("component", F.coalesce("component", "node"))
    here = here.withColumn("led", F.when(F.col("node") == F.col("leader"), F.col("shareable")).otherwise(F.col("overlap").cast("int")))
    here = materialize(here.select("s", "node", "size", "shareable", "after", "component", "led"))
    apart = here.groupBy("s").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    still = here.join(apart.select("s"), "s", "left_semi")
    pairs = _pairs(still, still, F.col("a_node") < F.col("b_node"), percent)
    pairs = pairs.join(counted.select("a", "b"), ["a", "b"], "left_anti")
    more = materialize(_similar(_overlaps(pairs, segments), percent))
    return component if more.isEmpty() else connected(links.union(more))


def least_shared_column(size: str, percent: int):
    return F.floor((percent * F.col(size) + 99) / 100).cast("int")


def _linked(sets: DataFrame, percent: int, fragments: int) -> DataFrame:
    """Add `component_id`, and `least`, the set that stands for the component, to the rows of `shingle_sets`."""
    candidates = sets.filter("shared IS NOT NULL")
    nodes = materialize(
        candidates.groupBy(F.col("set_low").alias("node"), "set_high", F.col("n_shingles").cast("int").alias("size")).agg(
            F.min("doc_id").alias("least_id"), F.first("shared").alias("shared")
        )
    )
    component = _components(nodes.select("node", "size", "shared"), percent, fragments)
    placed = nodes.select("node", "least_id").join(component, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = placed.join(names, "component").select("node", "component", "component_id")
    found = sets.join(named, (F.col("set_low") == F.col("node")) & F.col("shared").isNotNull(), "left")
    return found.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    fragments: int = FRAGMENTS,
) -> DataFrame:
    """`doc_id, n_shingles, component_id`, one row per input row.

    A document's set holds its distinct sequences of five words (A-Z lower-cased); a shorter text is one shingle as
    a whole. Documents without words (also NULL and empty texts) have an empty set and no link. The component is
    the smallest id reachable by links, the row's own included; NULL ids are passed over where there is another.
    Rows that share an id are documents of their own. Texts are taken whole, whatever their length; other columns
    are not read; an empty table gives an empty result.
    """
    return _linked(shingle_sets(docs, id_col, text_col, percent), percent, fragments).select("doc_id", "n_shingles", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, fragments: int = FRAGMENTS
) -> DataFrame:
    """One row of each group of linked documents stays: that of the smallest id. Columns as they were, whatever their names.

    Rows are numbered before they are compared, so of rows that share an id, or have none, each is judged by its own
    text; among equal ids, and where a group has no id, the row numbered first stays. Rows without words are linked
    with nothing and stay, NULL and empty texts and their repeats too. An empty table stays empty.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    # Stored with its number: what a task would number anew after a loss could not be joined back.
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("number"), row))
    text, own_id = F.col("row")[text_col], F.col("row")[id_col]
    sets = shingle_sets(numbered.select("number", text.alias("text")), "number", "text", percent)
    linked = _linked(sets, percent, fragments).filter("component IS NOT NULL")
    members = linked.select(F.col("doc_id").alias("number"), "component")
    named = members.join(numbered.select("number", own_id.alias("id")), "number")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "number")).alias("first"))
    goes = members.join(first, "component").filter(F.col("number") != F.col("first.number")).select("number")
    return numbered.join(goes, "number", "left_anti").select("row.*")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs)
