"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ORDER bytes, trained on the training documents. The probability of
a byte is sought in its longest context; a byte that was not met there costs an escape (estimated by the number of
different bytes met: method C), and shorter contexts leave out the bytes that were already ruled out (symbol
exclusion). A text ends with an end symbol, so the probabilities of all texts add up to one.

Chunks send their distinct (context, byte) strings with training counts to the range of the last three context
bytes. There the part of the trie below these bytes is complete, and gives every string its code length. The
trie above (contexts of up to two bytes, at most 2^24 entries by construction) goes to all tasks.
Words of the unigram base are counted by an exchange of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.llm import chunks
from cribado.llm.chunks import Chunk, Store
from cribado.session import materialize

#: Bytes of the longest context. Strings of ORDER + 1 bytes are numbers of 48 bits, without hashing.
ORDER = 5
#: Contexts of up to so many bytes are known to all tasks.
UPPER = 2
#: Bytes that no UTF-8 text holds stand before its start and for its end.
START, END = 0xFE, 0xFF
#: One document of so many is held out of training.
FOLDS = 10
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_STATE = "kind int, chunk long, range int, payload binary"


def held_out(number: int | None) -> bool:
    return zlib.crc32(b"" if number is None else str(number).encode()) % FOLDS == 0


class Strings:
    """The strings of a chunk: bytes with padding, block by block."""

    def __init__(self, chunk: Chunk):
        self.train = np.array([not held_out(i) for i in chunk.ids], bool)
        start, end = bytes([START] * ORDER), bytes([END])
        texts = [t.lower() for t in chunk.texts()]
        self.bytes = np.frombuffer(start + (end + start).join(texts) + end + start, np.uint8)
        self.lengths = chunk.ends - chunk.begins + ORDER + 1
        self.firsts = np.cumsum(self.lengths) - self.lengths
        #: Numbers of all strings in order, which the training documents hold how often.
        self.keys, self.counts = self._distinct()

    def block(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the symbols of one block, and their strings as numbers: the nearest context byte first."""
        first = at + ORDER
        last = min(first + chunks.BLOCK, len(self.bytes) - ORDER)
        symbol = self.bytes[first:last]
        key = symbol.astype(np.uint64)
        for back in range(1, ORDER + 1):
            key |= self.bytes[first - back : last - back].astype(np.uint64) << np.uint64(8 * (ORDER + 1 - back))
        real = np.flatnonzero(symbol != START)
        return real + first, key[real]

    def blocks(self):
        for at in range(0, len(self.bytes) - 2 * ORDER, chunks.BLOCK):
            yield self.block(at)

    def docs(self, places: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.firsts, places[[0, -1]], side="right") - 1
        counts = np.diff(np.append(np.searchsorted(places, self.firsts[low + 1 : high + 1]), len(places)), prepend=0)
        return np.repeat(np.arange(low, high + 1), counts)

    def _distinct(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = [], []
        for places, key in self.blocks():
            if len(places):
                flagged = key << np.uint64(1) | self.train[self.docs(places)].astype(np.uint64)
                found, times = np.unique(flagged, return_counts=True)
                keys.append(found >> np.uint64(1))
                counts.append(times * (found & np.uint64(1)).astype(np.int64))
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found, _, inverse = chunks.distinct(np.concatenate(keys))
        return found, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)

    def dealt(self, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the strings by range, and where each range begins."""
        near = chunks.mix64(self.keys >> np.uint64(8 * (ORDER + 1 - 3)))
        target = ((near >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(target, kind="stable")
        return order, np.searchsorted(target[order], np.arange(ranges + 1))


class Level:
    """All (context, byte) pairs of one context length: numbers in order, counts, and sums per context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.contexts, self.kinds, self.context_of = chunks.distinct(keys >> np.uint64(8))
        self.totals = np.bincount(self.context_of, weights=counts, minlength=len(self.contexts)).astype(np.int64)
        #: Per context, what the next shorter context has of the bytes met here.
        self.ruled_out = np.zeros(len(self.contexts), np.int64)

    def shorter(self) -> Level:
        """The level of contexts without the farthest byte."""
        keys = cut(self.keys)
        found, _, inverse = chunks.distinct(keys)
        return Level(found, np.bincount(inverse, weights=self.counts, minlength=len(found)).astype(np.int64))

    def look_up(self, values: np.ndarray, table: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        if not len(table):
            return [np.zeros(len(values), c.dtype) for c in columns]
        at = np.minimum(np.searchsorted(table, values), len(table) - 1)
        hit = table[at] == values
        return [np.where(hit, c[at], 0) for c in columns]

    def count(self, keys: np.ndarray) -> np.ndarray:
        return self.look_up(keys, self.keys, self.counts)[0]

    def rule_out(self, below: Level) -> None:
        weights = below.count(cut(self.keys))
        self.ruled_out = np.bincount(self.context_of, weights=weights, minlength=len(self.contexts)).astype(np.int64)


def cut(keys: np.ndarray) -> np.ndarray:
    """Numbers without the farthest context byte; it stands just above the symbol."""
    return (keys >> np.uint64(16)) << np.uint64(8) | (keys & np.uint64(0xFF))


def levels_from(keys: np.ndarray, counts: np.ndarray, longest: int, shortest: int) -> list[Level]:
    """Levels of contexts of `longest` down to `shortest` bytes from the pairs of the longest."""
    met = counts > 0
    levels = [Level(keys[met], counts[met])]
    for _ in range(longest - shortest):
        levels.append(levels[-1].shorter())
    for level, below in zip(levels, levels[1:]):
        level.rule_out(below)
    return levels


def code_lengths(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the probability of the last byte of each string after its context; levels from long to short, to none."""
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))
    kinds_ruled, weight_ruled = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for level in levels:
        total, kinds, next_ruled = level.look_up(keys >> np.uint64(8), level.contexts, level.totals, level.kinds, level.ruled_out)
        own = level.count(keys)
        left_kinds = kinds - kinds_ruled
        weight = np.maximum(total - weight_ruled + left_kinds, 1)
        met = own > 0
        chance = np.where(met, own, left_kinds) / weight
        out[todo] += np.where(left_kinds > 0, np.log10(np.where(left_kinds > 0, chance, 1.0)), 0.0)
        rest = ~met
        todo, keys = todo[rest], cut(keys[rest])
        kinds_ruled, weight_ruled = kinds[rest], next_ruled[rest]
    out[todo] -= np.log10(256 - kinds_ruled)
    return out


def _sum_pairs(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [chunks.unpack_parts(p, 2) for p in payloads]
    keys = np.concatenate([np.zeros(0, np.uint64), *(chunks.unpack_sorted(p[0]) for p in parts)])
    counts = np.concatenate([np.zeros(0, np.int64), *(chunks.unpack(p[1], np.int64) for p in parts)])
    found, _, inverse = chunks.distinct(keys)
    return found, np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)


def _pack_pairs(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return chunks.pack_parts(chunks.pack_sorted(keys), chunks.pack(counts.astype(np.int64)))


def _ask_strings(chunk: Chunk, ranges: int):
    s = Strings(chunk)
    order, bounds = s.dealt(ranges)
    for r in np.flatnonzero(np.diff(bounds)).tolist():
        own = order[bounds[r] : bounds[r + 1]]
        yield 1, chunk.number, r, _pack_pairs(s.keys[own], s.counts[own])
    upper, counts = s.keys, s.counts
    for _ in range(ORDER - UPPER):
        upper = cut(upper)
    found, _, inverse = chunks.distinct(upper)
    yield 0, chunk.number, None, _pack_pairs(found, np.bincount(inverse, weights=counts, minlength=len(found)))


def upper_trie(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The summed pairs of the short contexts: at most 2^24, whatever the corpus."""

    def add(table: pa.Table) -> pa.Table:
        keys, counts = _sum_pairs(table.column("payload").to_pylist())
        return pa.table({"payload": pa.array([_pack_pairs(keys, counts)], pa.binary())})

    for groups in (256, 16):
        group = F.pmod(F.xxhash64("payload"), F.lit(groups)).alias("group")
        parts = parts.select("payload").groupBy(group).applyInArrow(lambda table: add(table), "payload binary")
    return _sum_pairs([row.payload for row in parts.collect()])


def _reply_strings(upper: tuple[np.ndarray, np.ndarray]):
    def reply(payloads: list[bytes]) -> list[bytes]:
        parts = [chunks.unpack_parts(p, 2) for p in payloads]
        keys = [chunks.unpack_sorted(p[0]) for p in parts]
        counts = np.concatenate([chunks.unpack(p[1], np.int64) for p in parts])
        found, _, inverse = chunks.distinct(np.concatenate(keys))
        total = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)
        long = levels_from(found, total, ORDER, UPPER + 1)
        short = levels_from(*upper, UPPER, 0)
        long[-1].rule_out(short[0])
        lengths = code_lengths(found, [*long, *short]).astype(np.float32)
        return [chunks.pack(v) for v in np.split(lengths[inverse], np.cumsum([len(k) for k in keys])[:-1])]

    return reply


class Words:
    """The distinct words of a chunk (A-Z lower-cased) and how often training documents hold them."""

    def __init__(self, chunk: Chunk):
        starts, ends, self.firsts = chunk.words()
        self.keys, _, self.inverse = chunks.distinct(chunk.word_hashes(starts, ends, lower=True, seed=13))
        self.docs = np.repeat(np.arange(len(chunk.ids)), np.diff(self.firsts))
        self.train = np.array([not held_out(i) for i in chunk.ids], bool)
        weights = self.train[self.docs]
        self.counts = np.bincount(self.inverse, weights=weights, minlength=len(self.keys)).astype(np.int64)


def _ask_words(chunk: Chunk, ranges: int):
    w = Words(chunk)
    at = chunks.range_starts(w.keys, ranges)
    for r in np.flatnonzero(np.diff(at)).tolist():
        yield r, chunk.number, _pack_pairs(w.keys[at[r] : at[r + 1]], w.counts[at[r] : at[r + 1]])


def _count_words(asked: DataFrame) -> tuple[DataFrame, int, int]:
    """The training count of every word asked for; how many words and different words the training documents hold."""

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        payloads = table.column("payload").to_pylist()
        parts = [chunks.unpack_parts(p, 2) for p in payloads]
        keys = [chunks.unpack_sorted(p[0]) for p in parts]
        counts = np.concatenate([chunks.unpack(p[1], np.int64) for p in parts])
        found, _, inverse = chunks.distinct(np.concatenate(keys))
        total = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)
        replies = [chunks.pack(v) for v in np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])]
        n = len(replies)
        return pa.table(
            {
                "chunk": pa.concat_arrays([*table.column("chunk").chunks, pa.array([-1], pa.int64())]),
                "range": pa.array(table.column("range").to_pylist() + [0], pa.int32()),
                "payload": pa.array([*replies, None], pa.binary()),
                "words": pa.array([0] * n + [int(total.sum())], pa.int64()),
                "kinds": pa.array([0] * n + [int((total > 0).sum())], pa.int64()),
            }
        )

    schema = "chunk long, range int, payload binary, words long, kinds long"
    counted = materialize(asked.groupBy("range").applyInArrow(count, schema))
    sums = counted.agg(F.sum("words"), F.sum("kinds")).first()
    return counted.filter("chunk >= 0").select("chunk", "range", "payload"), sums[0] or 0, sums[1] or 0


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`, one row per input row.

    Documents whose crc32 of the id as text is a multiple of FOLDS are held out (a NULL id counts as an empty text: held
    out); all others train. `score` is the log10 probability of the whole text, A-Z lower-cased, with its end;
    `base_score` that of its words and end as unigrams. NULL and empty texts consist of their end. Repeated rows
    count as often as they stand there. Other columns are not read; an empty table gives an empty result.
    """
    store = Store(docs, id_col, text_col)
    ranges = store.ranges
    word_answers, words, kinds = _count_words(store.run(lambda chunk: _ask_words(chunk, ranges), chunks.ASK_SCHEMA))
    parts, asked = chunks.split_kinds(store.run(lambda chunk: _ask_strings(chunk, ranges), _STATE))
    upper = docs.sparkSession.sparkContext.broadcast(upper_trie(parts))
    answers = chunks.answer(asked, lambda payloads: _reply_strings(upper.value)(payloads))
    id_text = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    ends = docs.filter(F.crc32(id_text) % FOLDS != 0).count()
    total, different = words + ends, kinds + (ends > 0)

    def score(chunk: Chunk, word_blobs, blobs):
        w = Words(chunk)
        known = np.concatenate([np.zeros(0, np.int64), *(chunks.unpack(b, np.int64) for b in word_blobs)])
        chance = lambda c: np.log10((c + 0.1) / (total + 0.1 * (different + 1)))
        n = len(chunk.ids)
        count = known[w.inverse]
        base = np.bincount(w.docs, weights=chance(count), minlength=n) + chance(np.int64(ends))
        met = np.bincount(w.docs, weights=count > 0, minlength=n).astype(int) + (ends > 0)
        s = Strings(chunk)
        order, _ = s.dealt(ranges)
        lengths = np.empty(len(s.keys))
        lengths[order] = np.concatenate([np.zeros(0, np.float32), *(chunks.unpack(b, np.float32) for b in blobs)])
        scores = np.zeros(n)
        for places, keys in s.blocks():
            if len(places):
                codes, found = pd.factorize(keys)
                values = lengths[np.searchsorted(s.keys, found)]
                scores += np.bincount(s.docs(places), weights=values[codes], minlength=n)
        tokens = np.diff(w.firsts) + 1
        for i, number in enumerate(chunk.ids):
            yield number, not w.train[i], int(tokens[i]), int(met[i]), total, float(base[i]), float(scores[i])

    return store.run(score, _RESULT, word_answers, answers)


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
