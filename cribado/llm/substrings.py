"""Substring dedup: windows of words repeated at one length are extended to twice that length.

Starting from windows of a quarter of the wanted length, only places whose window is repeated somewhere stay
candidates; a window of twice the length is asked about only where both its halves are candidates. At
the wanted length every repeated window learns whether it is the first of its kind, in the order of
(document id, place). Words under a window that is not the first are removed.

Between levels a chunk keeps one bit per word. The hashes of the shorter windows (48 bits) only choose
candidates; at the last level two independent hashes of the words stand for them, 64 bits for the place of a window
and 64 to check it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from cribado.llm import chunks
from cribado.llm.chunks import Chunk, Store

LENGTH = 20
_KEY_BITS = 48
_RESULT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
_STATE = "kind int, chunk long, range int, payload binary"


class Windows:
    """Hashes of a chunk's windows at one length after the other."""

    def __init__(self, chunk: Chunk, base: int):
        self.starts, self.ends, self.firsts = chunk.words()
        self.words = chunk.word_hashes(self.starts, self.ends)
        self.length, self.hashes = base, chunks.windows(self.words, base)

    def places(self) -> np.ndarray:
        return chunks.window_places(self.firsts, self.length)

    def double(self, alive: np.ndarray) -> np.ndarray:
        """Go to twice the length; `alive` marks words where a window of the old length is a candidate."""
        old = self.length
        n = max(0, len(self.hashes) - old)
        self.hashes = chunks.mix64(self.hashes[:n] * np.uint64(0xA24BAED4963EE407) + self.hashes[old : old + n])
        self.length = 2 * old
        places = self.places()
        return places[alive[places] & alive[places + old]]


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - _KEY_BITS)


def _ask_repeated(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    distinct, counts, _ = chunks.distinct(keys)
    at = chunks.range_starts(distinct, ranges, _KEY_BITS)
    for r in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[r], at[r + 1])
        yield r, chunks.pack_parts(chunks.pack_sorted(distinct[part]), chunks.pack_bits(counts[part] > 1))


def _reply_repeated(payloads: list[bytes]) -> list[bytes]:
    """For each key whether it is met twice or more, in one chunk or in several."""
    keys, counts = [], []
    for payload in payloads:
        packed, many = chunks.unpack_parts(payload, 2)
        keys.append(chunks.unpack_sorted(packed))
        counts.append(chunks.unpack_bits(many, len(keys[-1])) + np.int64(1))
    _, _, inverse = chunks.distinct(np.concatenate(keys))
    total = np.bincount(inverse, weights=np.concatenate(counts))
    repeated = np.split(total[inverse] > 1, np.cumsum([len(k) for k in keys])[:-1])
    return [chunks.pack_bits(r) for r in repeated]


def _alive(windows_: Windows, places: np.ndarray, ranges: int, answers: list[bytes]) -> np.ndarray:
    """One flag per word from the answers about the windows at `places`."""
    alive = np.zeros(len(windows_.words), bool)
    distinct, _, inverse = chunks.distinct(_short(windows_.hashes[places]))
    at = chunks.range_starts(distinct, ranges, _KEY_BITS)
    sizes = np.diff(at)
    flags = [chunks.unpack_bits(a, n) for a, n in zip(answers, sizes[sizes > 0].tolist())]
    if flags:
        alive[places] = np.concatenate(flags)[inverse]
    return alive


def _final_keys(chunk: Chunk, windows_: Windows, places: np.ndarray):
    """Windows in the order of (hash, check, document, place), and which begin a kind of their own."""
    keys = windows_.hashes[places]
    checks = chunks.windows(chunk.word_hashes(windows_.starts, windows_.ends, seed=3), windows_.length)[places]
    doc = np.searchsorted(windows_.firsts, places, side="right") - 1
    ids, local = chunk.order_ids()[doc], places - windows_.firsts[doc]
    order = np.lexsort((local, ids, checks, keys))
    keys, checks = keys[order], checks[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    return order, new, keys[new], checks[new], ids[order][new], local[order][new]


def _ask_first(found, ranges: int) -> Iterator[tuple[int, bytes]]:
    _, _, keys, checks, ids, local = found
    at = chunks.range_starts(keys, ranges)
    for r in np.flatnonzero(np.diff(at)).tolist():
        p = slice(at[r], at[r + 1])
        yield r, chunks.pack_parts(
            chunks.pack_sorted(keys[p]), chunks.pack(checks[p]), chunks.pack(ids[p]), chunks.pack(local[p].astype(np.int64))
        )


def _reply_first(payloads: list[bytes]) -> list[bytes]:
    """For each key whether the asking chunk has the first window of its kind (all that share this first place)."""
    parts = [chunks.unpack_parts(p, 4) for p in payloads]
    keys = [chunks.unpack_sorted(p[0]) for p in parts]
    every = np.concatenate(keys)
    checks = np.concatenate([chunks.unpack(p[1], np.uint64) for p in parts])
    ids, local = (np.concatenate([chunks.unpack(p[i], np.int64) for p in parts]) for i in (2, 3))
    order = np.lexsort((local, ids, checks, every))
    new = np.ones(len(order), bool)
    new[1:] = (every[order][1:] != every[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    head = order[new][np.cumsum(new) - 1]  # the first of each one's kind
    first = np.empty(len(order), bool)
    first[order] = (ids[order] == ids[head]) & (local[order] == local[head])
    return [chunks.pack_bits(f) for f in np.split(first, np.cumsum([len(k) for k in keys])[:-1])]


def _results(chunk: Chunk, windows_: Windows, places: np.ndarray, ranges: int, answers: list[bytes], texts: bool):
    removed = np.zeros(len(windows_.words) + 1, np.int32)
    if len(places):
        order, new, keys, _, ids, local = found = _final_keys(chunk, windows_, places)
        sizes = np.diff(chunks.range_starts(keys, ranges))
        own = np.concatenate([chunks.unpack_bits(a, n) for a, n in zip(answers, sizes[sizes > 0].tolist())])
        kind = np.cumsum(new) - 1
        doc = np.searchsorted(windows_.firsts, places, side="right") - 1
        place = (places - windows_.firsts[doc])[order]
        first = own[kind] & (chunk.order_ids()[doc][order] == ids[kind]) & (place == local[kind])
        later = places[order[~first]]
        np.add.at(removed, later, 1)
        np.add.at(removed, later + windows_.length, -1)
    gone = np.cumsum(removed[:-1]) > 0
    for doc, (number, text) in enumerate(zip(chunk.ids, chunk.texts())):
        mine = gone[windows_.firsts[doc] : windows_.firsts[doc + 1]]
        words, n_removed = text.split(), int(mine.sum())
        kept = b" ".join([w for w, g in zip(words, mine.tolist()) if not g] if n_removed else words)
        yield number, len(words), n_removed, kept.decode("utf-8", "replace") if texts else None, hashlib.sha256(kept).hexdigest()


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, texts: bool = True) -> DataFrame:
    """`doc_id, n_words, n_removed, kept, kept_sha256`: words under a window that starts earlier elsewhere are removed.

    `kept` are the remaining words with single spaces (NULL without `texts`). NULL and empty texts have no
    words. Documents are ordered by id, NULL last; rows with one id are one document for this order, so of
    windows at the same place of such rows none is earlier. Texts are processed whole, whatever their length;
    other columns are not read; an empty table gives an empty result. `length` must be a multiple of 4.
    """
    store = Store(docs, id_col, text_col)
    base, ranges = length // 4, store.ranges

    def first_level(chunk: Chunk):
        w = Windows(chunk, base)
        for r, payload in _ask_repeated(_short(w.hashes[w.places()]), ranges):
            yield r, chunk.number, payload

    def second_level(chunk: Chunk, answers):
        w = Windows(chunk, base)
        alive = _alive(w, w.places(), ranges, answers)
        yield 0, chunk.number, None, chunks.pack_bits(alive)
        places = w.double(alive)
        for r, payload in _ask_repeated(_short(w.hashes[places]), ranges):
            yield 1, chunk.number, r, payload

    def third_level(chunk: Chunk, answers, state):
        w = Windows(chunk, base)
        places = w.double(chunks.unpack_bits(state, len(w.words)))
        alive = _alive(w, places, ranges, answers)
        yield 0, chunk.number, None, chunks.pack_bits(alive)
        places = w.double(alive)
        if len(places):
            for r, payload in _ask_first(_final_keys(chunk, w, places), ranges):
                yield 1, chunk.number, r, payload

    def last(chunk: Chunk, answers, state):
        w = Windows(chunk, base)
        w.double(np.zeros(len(w.words), bool))
        places = w.double(chunks.unpack_bits(state, len(w.words)))
        yield from _results(chunk, w, places, ranges, answers, texts)

    asked = store.run(first_level, chunks.ASK_SCHEMA)
    answers = chunks.answer(asked, _reply_repeated)
    state, asked = chunks.split_kinds(store.run(second_level, _STATE, answers))
    answers = chunks.answer(asked, _reply_repeated)
    state, asked = chunks.split_kinds(store.run(third_level, _STATE, answers, state))
    answers = chunks.answer(asked, _reply_first)
    return store.run(last, _RESULT, answers, state)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_windows(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
