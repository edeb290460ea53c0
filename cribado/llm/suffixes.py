"""Suffix-array dedup of exact byte strings.

A string of LENGTH bytes that stands in two places holds the same anchor in both: the ANCHOR-byte string of the
least hash among those inside it. So:

1. Chunks ask which anchors other documents hold too.
2. For each occurrence of a shared anchor, the bytes around it that a window with this anchor can reach go, once
   per distinct content and with the least document id, to the range of the anchor's hash.
3. There the suffixes that begin with the same anchor are sorted: a mergesort whose comparisons find the common
   extension of two suffixes by binary search over prefix polynomial hashes, in logarithmic steps. The order of the
   suffixes that begin one byte earlier follows from it by that byte, and so on as far as windows reach.
   The order is held against the bytes, and a group that a collision of hashes has put out of order is sorted
   anew; so equal strings are neighbours, which their bytes tell as well. The least document of each run of equal
   strings decides for all others.
4. Chunks mark the windows found and join them to spans.

An anchor in very many documents would bring all their surroundings to one range. Its windows are sent one by one
instead, each to the range of its own hash, where equal ones meet.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from cribado.llm import chunks
from cribado.llm.chunks import Chunk, Store

LENGTH = 50
ANCHOR = 24
#: Bytes before an anchor that its windows can reach, and the width of a row of bytes around it.
REACH = LENGTH - ANCHOR
WIDTH = REACH + LENGTH
#: From so many documents on, windows of an anchor are sent by their own hash.
HOT_DOCUMENTS = 20_000
#: Rows whose suffixes are sorted together, if no single anchor has more.
SORT_ROWS = 50_000
_KEY_BITS = 48
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
_STATE = "kind int, chunk long, range int, payload binary"


def rolling(data: np.ndarray, length: int, seed: int = 3) -> np.ndarray:
    """A hash of the `length` bytes at every place that has them, block by block."""
    codes = chunks.byte_codes(seed)
    out = np.empty(max(0, len(data) - length + 1), np.uint64)
    for at in range(0, len(out), chunks.BLOCK):
        end = min(at + chunks.BLOCK, len(out))
        up, down = chunks.powers(end - at + length)
        part = codes[data[at : end + length - 1]]
        part *= up[: len(part)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        out[at:end] = chunks.mix64((total[length:] - total[:-length]) * down[: end - at])
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` consecutive values, by doubling."""
    least, have = values, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least


class Anchors:
    """The anchors of a chunk's windows: places, hashes, documents."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        step = np.zeros(max(0, len(chunk.bytes) - LENGTH + 1) + 1, np.int8)
        long = chunk.ends - chunk.begins >= LENGTH
        np.add.at(step, chunk.begins[long], 1)
        np.add.at(step, chunk.ends[long] - LENGTH + 1, -1)
        self.fits = np.cumsum(step[:-1], dtype=np.int8) > 0  # a whole window begins here
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, hashes, least in self._blocks():
            marks = np.zeros(len(hashes), bool)
            for shift in range(REACH + 1):
                # All places of the least hash are anchors, so equal strings have the same ones.
                part = hashes[shift : shift + len(least)] == least
                marks[shift : shift + len(least)] |= self.fits[at : at + len(least)] & part
            places.append(np.flatnonzero(marks) + at)
            found.append(hashes[marks])
        self.places, first = np.unique(np.concatenate(places), return_index=True)  # blocks overlap by REACH
        self.hashes = np.concatenate(found)[first]
        self.docs = np.searchsorted(chunk.ends, self.places)
        self.ids = chunk.order_ids()[self.docs]

    def _blocks(self):
        """For blocks of window places: the first, the hashes of all anchors they reach, the least of each window."""
        for at in range(0, len(self.fits), chunks.BLOCK):
            end = min(at + chunks.BLOCK, len(self.fits))
            hashes = rolling(self.chunk.bytes[at : end + LENGTH - 1], ANCHOR)
            yield at, hashes, sliding_least(hashes, REACH + 1)

    def least(self) -> np.ndarray:
        """The least hash inside each window."""
        return np.concatenate([np.zeros(0, np.uint64), *(least for _, _, least in self._blocks())])

    def keys(self) -> np.ndarray:
        return self.hashes >> np.uint64(64 - _KEY_BITS)

    def reach(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the document before (at most REACH) and from (at most LENGTH) the anchors."""
        places, docs = self.places[which], self.docs[which]
        before = np.minimum(REACH, places - self.chunk.begins[docs])
        return before.astype(np.uint8), np.minimum(LENGTH, self.chunk.ends[docs] - places).astype(np.uint8)


class Rows:
    """Bytes around places, aligned at the place: what lies outside is zero."""

    def __init__(self, data: np.ndarray, before: np.ndarray, after: np.ndarray, ids: np.ndarray):
        self.data, self.before, self.after, self.ids = data, before, after, ids

    @classmethod
    def around(cls, chunk: Chunk, places, before, after, ids):
        padded = np.concatenate([np.zeros(REACH, np.uint8), chunk.bytes, np.zeros(LENGTH, np.uint8)])
        data = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[places]
        columns = np.arange(WIDTH)
        for at in range(0, len(data), 1 << 16):
            part = slice(at, at + (1 << 16))
            data[part][(columns < REACH - before[part, None]) | (columns >= REACH + after[part, None])] = 0
        return cls(data, before, after, ids)

    @classmethod
    def joined(cls, parts: list[Rows]):
        return cls(*(np.concatenate([getattr(r, name) for r in parts]) for name in ("data", "before", "after", "ids")))

    def take(self, which) -> Rows:
        return Rows(self.data[which], self.before[which], self.after[which], self.ids[which])

    def hashes(self, first: int = 0, last: int = WIDTH, seed: int = 5) -> np.ndarray:
        codes, up = chunks.byte_codes(seed), chunks.powers(WIDTH)[0][: last - first]
        out = np.empty(len(self.data), np.uint64)
        for at in range(0, len(out), 1 << 15):
            out[at : at + (1 << 15)] = (codes[self.data[at : at + (1 << 15), first:last]] * up).sum(axis=1)
        return chunks.mix64(out)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the least id of each content, and for every row the place of its content among them."""
        keys = chunks.mix64(self.hashes() + self.before * np.uint64(256) + self.after)
        order = np.lexsort((self.ids, keys))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (keys[a] != keys[b]) | (self.before[a] != self.before[b]) | (self.after[a] != self.after[b])
        same = np.flatnonzero(~new[1:])
        for at in range(0, len(same), 1 << 16):  # equal hashes: compare the bytes too
            part = same[at : at + (1 << 16)]
            new[part + 1] = (self.data[order[part + 1]] != self.data[order[part]]).any(axis=1)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return order[new], inverse

    def pack(self) -> bytes:
        return chunks.pack_parts(
            chunks.compress(self.data.tobytes()), chunks.pack(self.before), chunks.pack(self.after), chunks.pack(self.ids)
        )

    @classmethod
    def unpack(cls, blob: bytes):
        data, before, after, ids = chunks.unpack_parts(blob, 4)
        data = np.frombuffer(chunks.decompress(data), np.uint8).reshape(-1, WIDTH)
        return cls(data, chunks.unpack(before, np.uint8), chunks.unpack(after, np.uint8), chunks.unpack(ids, np.int64))


class Suffixes:
    """Suffixes of rows that begin in one column, compared by prefix polynomial hashes."""

    def __init__(self, rows: Rows):
        self.rows = rows
        codes = chunks.byte_codes(7)[rows.data] * chunks.powers(WIDTH)[0][:WIDTH]
        self.prefix = np.zeros((len(rows.data), WIDTH + 1), np.uint64)
        np.cumsum(codes, axis=1, out=self.prefix[:, 1:])
        self.ends = REACH + rows.after.astype(np.int64)

    def extension(self, a: np.ndarray, b: np.ndarray, column: int) -> np.ndarray:
        """The common length of two suffixes, at most LENGTH."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(np.minimum(self.ends[a], self.ends[b]) - column, LENGTH)
        base = self.prefix[a, column] - self.prefix[b, column]
        for _ in range(LENGTH.bit_length()):
            middle = (low + high + 1) >> 1
            equal = self.prefix[a, column + middle] - self.prefix[b, column + middle] == base
            low, high = np.where(equal, middle, low), np.where(equal, high, np.maximum(middle - 1, low))
        return low

    def less(self, a: np.ndarray, b: np.ndarray, column: int) -> np.ndarray:
        common = self.extension(a, b, column)
        at = np.minimum(column + common, WIDTH - 1)
        differ = common < np.minimum(np.minimum(self.ends[a], self.ends[b]) - column, LENGTH)
        shorter = (common < LENGTH) & (self.ends[a] < self.ends[b])
        return np.where(differ, self.rows.data[a, at] < self.rows.data[b, at], shorter)

    def sort(self, members: np.ndarray, sizes: np.ndarray, column: int) -> np.ndarray:
        """Mergesort within consecutive groups of the given sizes, all groups at once, runs doubling in length."""
        members = members.copy()
        begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
        lengths = np.repeat(sizes, sizes)
        places = np.arange(len(members)) - begins
        width = 1
        while width < sizes.max(initial=0):
            run = places // width
            low = np.minimum((run ^ 1) * width, lengths)
            high = np.minimum(low + width, lengths)
            first, right = low.copy(), (run & 1).astype(bool)
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                mine, other = members[open_], members[begins[open_] + middle]
                swap = right[open_]
                before = self.less(np.where(swap, mine, other), np.where(swap, other, mine), column)
                passed = before ^ swap  # of equal suffixes those of the left run come first
                low[open_] = np.where(passed, middle + 1, low[open_])
                high[open_] = np.where(passed, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            moved = np.empty_like(members)
            moved[begins + (run >> 1) * 2 * width + places - run * width + low - first] = members
            members, width = moved, 2 * width
        return self._verified(members, sizes, column)

    def _verified(self, members: np.ndarray, sizes: np.ndarray, column: int) -> np.ndarray:
        """The order found by hashes, held against the bytes: a group that a collision has put out of order is sorted anew."""
        group = np.repeat(np.arange(len(sizes)), sizes)
        pairs = np.flatnonzero(group[1:] == group[:-1])
        wrong = set()
        for at in range(0, len(pairs), 1 << 16):
            part = pairs[at : at + (1 << 16)]
            a, b = members[part], members[part + 1]
            differ = self.rows.data[a, column : column + LENGTH] != self.rows.data[b, column : column + LENGTH]
            first = column + differ.argmax(axis=1)
            after = self.rows.data[a, first] > self.rows.data[b, first]
            wrong.update(group[part[differ.any(axis=1) & after]].tolist())
        for number in wrong:
            own = np.flatnonzero(group == number)
            members[own] = sorted(members[own].tolist(), key=lambda row: self.rows.data[row, column : column + LENGTH].tobytes())
        return members

    def least_ids(self, ordered: np.ndarray, group: np.ndarray, column: int) -> np.ndarray:
        """For suffixes in order, the least id among those of a group with the same LENGTH bytes from this column."""
        new = np.ones(len(ordered), bool)
        a, b = ordered[1:], ordered[:-1]
        whole = self.prefix[:, column + LENGTH] - self.prefix[:, column]
        new[1:] = (group[a] != group[b]) | (whole[a] != whole[b])
        same = np.flatnonzero(~new[1:])
        window = self.rows.data[:, column : column + LENGTH]
        new[same + 1] = (window[a[same]] != window[b[same]]).any(axis=1)
        least = np.minimum.reduceat(self.rows.ids[ordered], np.flatnonzero(new)) if len(ordered) else ordered
        return least[np.cumsum(new) - 1]


def _ask(chunk: Chunk, ranges: int):
    a = Anchors(chunk)
    keys = a.keys()
    order = np.lexsort((a.docs, keys))
    keys, docs = keys[order], a.docs[order]
    pair = np.ones(len(keys), bool)
    pair[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    distinct, counts, _ = chunks.distinct(keys[pair])
    at = chunks.range_starts(distinct, ranges, _KEY_BITS)
    for r in np.flatnonzero(np.diff(at)).tolist():
        p = slice(at[r], at[r + 1])
        yield r, chunk.number, chunks.pack_parts(chunks.pack_sorted(distinct[p]), chunks.pack(counts[p].astype(np.uint32)))


def _reply_shared(hot: int):
    def reply(payloads: list[bytes]) -> list[bytes]:
        """For each anchor 0 (one document has it), 1 (several) or 2 (very many)."""
        parts = [chunks.unpack_parts(p, 2) for p in payloads]
        keys = [chunks.unpack_sorted(p[0]) for p in parts]
        counts = np.concatenate([chunks.unpack(p[1], np.uint32) for p in parts])
        _, _, inverse = chunks.distinct(np.concatenate(keys))
        total = np.bincount(inverse, weights=counts)[inverse]
        kind = (total > 1).astype(np.uint8) + (total >= hot)
        return [chunks.pack(k) for k in np.split(kind, np.cumsum([len(k) for k in keys])[:-1])]

    return reply


class Occurrences(NamedTuple):
    """Where rows stand in a chunk: place, bytes before and after, document id, number of the row."""

    places: np.ndarray
    before: np.ndarray
    after: np.ndarray
    ids: np.ndarray
    row: np.ndarray


def _shared_rows(chunk: Chunk, kinds: np.ndarray, a: Anchors) -> tuple[Rows, np.ndarray, Occurrences]:
    """Rows to send, their routes, and their occurrences; `kinds` has 0, 1 or 2 for each anchor.

    Rows of a frequent anchor are made distinct for one distance of windows at a time, so a chunk never holds the bytes
    of all its windows.
    """
    parts, routes, occurrences, count = [], [], [], 0

    def add(places, before, after, ids, anchors=None):
        nonlocal count
        rows = Rows.around(chunk, places, before, after, ids)
        heads, inverse = rows.distinct()
        parts.append(rows.take(heads))
        routes.append(parts[-1].hashes(seed=9) if anchors is None else anchors[heads])
        occurrences.append((places, before, after, ids, inverse + count))
        count += len(heads)

    plain = np.flatnonzero(kinds == 1)
    add(a.places[plain], *a.reach(plain), a.ids[plain], a.hashes[plain])
    hot = np.flatnonzero(kinds == 2)
    least = a.least() if len(hot) else None
    for distance in range(REACH + 1 if len(hot) else 0):
        starts = a.places[hot] - distance
        own = np.flatnonzero((starts >= chunk.begins[a.docs[hot]]) & (starts < len(least)))
        own = own[a.fits[starts[own]] & (least[starts[own]] == a.hashes[hot][own])]
        add(starts[own], np.zeros(len(own), np.uint8), np.full(len(own), LENGTH, np.uint8), a.ids[hot][own])
    joined = Occurrences(*(np.concatenate(column) for column in zip(*occurrences)))
    return Rows.joined(parts), chunks.mix64(np.concatenate(routes)), joined


def _least_per_window(rows: Rows) -> np.ndarray:
    """For each row and distance before its anchor, the least id that has the same window."""
    least = np.repeat(rows.ids[:, None], REACH + 1, axis=1)
    anchors = rows.hashes(REACH, REACH + ANCHOR, seed=11)
    order = np.argsort(anchors, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = anchors[order][1:] != anchors[order][:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    order = order[np.repeat(sizes > 1, sizes)]  # an anchor with one content has nothing to sort
    sizes = sizes[sizes > 1]
    block = (np.cumsum(sizes) - 1) // SORT_ROWS
    ends = np.cumsum(sizes)
    for b in np.unique(block):
        own = np.flatnonzero(block == b)
        members = order[ends[own[0]] - sizes[own[0]] : ends[own[-1]]]
        part = rows.take(members)
        suffixes = Suffixes(part)
        group = np.repeat(np.arange(len(own)), sizes[own])
        ordered = suffixes.sort(np.arange(len(members)), sizes[own], REACH)
        for distance in range(REACH + 1):
            if distance:  # the order of suffixes one byte longer: by this byte, then by the order so far
                ordered = ordered[part.before[ordered] >= distance]
                byte = part.data[ordered, REACH - distance]
                ordered = ordered[np.argsort(group[ordered] << 8 | byte, kind="stable")]
            valid = ordered[part.after[ordered].astype(int) + distance >= LENGTH]
            least[members[valid], distance] = suffixes.least_ids(valid, group, REACH - distance)
    return least


def _reply_windows(payloads: list[bytes]) -> list[bytes]:
    """For each row one bit per distance: whether a smaller document has this window."""
    sent = [Rows.unpack(p) for p in payloads]
    sizes = [len(r.ids) for r in sent]
    rows = Rows.joined(sent)
    del sent
    heads, inverse = rows.distinct()
    least = _least_per_window(rows.take(heads))
    masks = np.zeros(len(rows.ids), np.uint32)
    for distance in range(REACH + 1):
        valid = (rows.before >= distance) & (rows.after.astype(int) + distance >= LENGTH)
        masks |= (valid & (least[inverse, distance] < rows.ids)).astype(np.uint32) << np.uint32(distance)
    return [chunks.pack(m) for m in np.split(masks, np.cumsum(sizes)[:-1])]


def _dealt(rows: Rows, route: np.ndarray, ranges: int):
    """Distinct rows in the order of their range, and for every row its place in this order."""
    heads, inverse = rows.distinct()
    target = ((route[heads] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(target, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return heads[order], target[order].astype(np.int64), rank[inverse]


def _removed(chunk: Chunk, found: Occurrences, least: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Bytes to remove, from the least id in the chunk and the answer for each occurrence."""
    starts = np.zeros(len(chunk.bytes) + 1, bool)
    mask = np.where(found.ids == least, masks, np.uint32(0xFFFFFFFF))
    for distance in range(REACH + 1):
        valid = (found.before >= distance) & (found.after >= LENGTH - distance)
        starts[found.places[valid & ((mask >> np.uint32(distance)) & 1).astype(bool)] - distance] = True
    begin = np.flatnonzero(starts)
    step = np.zeros(len(chunk.bytes) + 1, np.int16)
    step[begin] += 1
    step[begin + LENGTH] -= 1
    return np.cumsum(step[:-1], dtype=np.int16) > 0


def dedup_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, hot: int = HOT_DOCUMENTS) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`, one row per input row.

    A byte is removed if a string of LENGTH bytes over it also starts in a document with a smaller id; `kept` is the
    rest (NULL without `keep`). NULL and empty texts have no bytes; a NULL id is larger than any other; rows that
    share an id do not remove each other's bytes. Texts are taken whole; matches never cross documents;
    other columns are not read; an empty table gives an empty result. `hot` changes the route of frequent
    anchors, not the result.
    """
    store = Store(docs, id_col, text_col)
    ranges = store.ranges

    def kinds_of(a: Anchors, answers) -> np.ndarray:
        _, _, inverse = chunks.distinct(a.keys())
        return np.concatenate([chunks.unpack(x, np.uint8) for x in answers])[inverse] if answers else np.zeros(0, np.uint8)

    def send(chunk: Chunk, answers):
        a = Anchors(chunk)
        kinds = kinds_of(a, answers)
        yield 0, chunk.number, None, chunks.pack(kinds) if len(kinds) else None
        rows, route, _ = _shared_rows(chunk, kinds, a)
        heads, target, _ = _dealt(rows, route, ranges)
        bounds = np.searchsorted(target, np.arange(ranges + 1))
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            yield 1, chunk.number, r, rows.take(heads[bounds[r] : bounds[r + 1]]).pack()

    def mark(chunk: Chunk, answers, state):
        gone = np.zeros(len(chunk.bytes), bool)
        if state is not None and answers:
            rows, route, found = _shared_rows(chunk, chunks.unpack(state, np.uint8), Anchors(chunk))
            heads, _, inverse = _dealt(rows, route, ranges)
            masks = np.concatenate([chunks.unpack(x, np.uint32) for x in answers])
            row = inverse[found.row]
            gone = _removed(chunk, found, rows.ids[heads][row], masks[row])
        for number, begin, end in zip(chunk.ids, chunk.begins.tolist(), chunk.ends.tolist()):
            mine = gone[begin:end]
            kept = chunk.bytes[begin:end][~mine].tobytes()
            spans = int((mine[1:] & ~mine[:-1]).sum()) + int(mine[:1].sum())
            yield number, end - begin, int(mine.sum()), spans, kept if keep else None, hashlib.sha256(kept).hexdigest()

    answers = chunks.answer(store.run(lambda chunk: _ask(chunk, ranges), chunks.ASK_SCHEMA), _reply_shared(hot))
    state, sent = chunks.split_kinds(store.run(send, _STATE, answers))
    return store.run(mark, _RESULT, chunks.answer(sent, _reply_windows), state)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_strings(docs, keep=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
