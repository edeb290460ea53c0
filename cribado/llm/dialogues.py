"""Repair of the turn structure of conversations by Viterbi search with survivor coalescence.

A conversation should be an optional system turn, then pairs of user and assistant. A row may be kept, get another
role, or be deleted, and empty turns may be inserted; each edit has a cost. The search keeps one cheapest path (a
survivor) per state of the structure. Survivors are leaves of a tree of back pointers whose nodes count their
children: a node that no survivor hangs from goes, and as long as the root has one child, all survivors share that
edit, so it is emitted and forgotten. What is held is the unresolved part alone, not the conversation. That is
a few rows, except where an early edit hangs on the end (rows that all need another role, an odd number of them); then
it is the rest of the conversation, or of its range (below).

Ties go to the first sequence of edits in ASCII order. All survivors have edited the same number of rows and end with
the edit of a row, so none is a prefix of another; the order of their complete unresolved parts is carried along, as
the order in which they are listed.

Conversations are dealt out by id, sorted, and streamed. One with very many rows is cut into ranges instead; each
range is searched from every state it may begin with, a chain over the ranges picks the states that were met, and
the ranges then apply their edits side by side.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cribado.llm.common import parallelism
from cribado.session import materialize

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Fixed value: the audit letters.
KEEP_LETTER, REROLE_LETTER, DELETE_LETTER, INSERT_LETTER = "KRDI"
#: Initials that can be kept; any other is OTHER.
OTHER = 3
INITIALS = {"s": 0, "u": 1, "a": 2}
#: The state that a turn with an initial leads to.
MOVES = (
    {0: SYSTEM, 1: USER},
    {1: USER},
    {2: ASSISTANT},
    {1: USER},
)
#: Where an inserted or renamed turn leads: the structure leaves one choice.
ONWARD = (USER, USER, ASSISTANT, USER)
#: Turns that are missing at the end of a conversation.
MISSING = (0, 2, 1, 0)
#: MARGIN[y][x]: what y pays at most, beyond x, to end with the turns of any path that goes on from x: an inserted
#: turn (3), the two of a first pair (6), a deleted system turn (4), or both.
MARGIN = (
    (0, 0, 3, 0),
    (6, 0, 3, 6),
    (7, 3, 0, 3),
    (4, 0, 3, 0),
)

#: A conversation above either of these is cut into ranges of about this size.
RANGE_ROWS = 50_000
RANGE_BYTES = 32_000_000


def code_of(initial: int, must_go: bool, truncated: bool) -> int:
    return initial | must_go << 2 | truncated << 3


@lru_cache(maxsize=None)
def step(survivors: tuple, code: int) -> tuple:
    """One row further: new survivors (state, cost above the least), the cost that all share, and (old place, edits).

    Survivors are listed in the order of their paths. There are few such lists, as costs that lie too far
    above another survivor's end the path.
    """
    initial, must_go, truncated = code & 3, code >> 2 & 1, code >> 3 & 1
    stay = TRUNCATED * truncated
    best: dict[int, tuple] = {}
    for place, (state, cost) in enumerate(survivors):
        for inserted in range(3):
            edits = INSERT_LETTER * inserted
            options = [(state, DELETE_LETTER, DELETE)]
            if not must_go:
                if initial in MOVES[state]:
                    options.append((MOVES[state][initial], KEEP_LETTER, stay))
                options.append((ONWARD[state], REROLE_LETTER, REROLE + stay))
            for after, letter, price in options:
                path = (cost + price, place, edits + letter)
                if after not in best or path < best[after]:
                    best[after] = path
            state, cost = ONWARD[state], cost + INSERT
    paths = sorted((place, edits, cost, state) for state, (cost, place, edits) in best.items())
    alive = [
        (place, edits, cost, state)
        for i, (place, edits, cost, state) in enumerate(paths)
        if not any(
            other[2] + MARGIN[other[3]][state] < cost or other[2] + MARGIN[other[3]][state] == cost and j < i
            for j, other in enumerate(paths)
            if j != i
        )
    ]
    least = min(p[2] for p in alive)
    return tuple((p[3], p[2] - least) for p in alive), least, tuple((p[0], p[1]) for p in alive)


class Node:
    """The edits of one row, on a path; as long as `kids` go on from here, four at most, the node stays."""

    __slots__ = ("parent", "edits", "kids")

    def __init__(self, parent: Node | None, edits: str):
        self.parent, self.edits, self.kids = parent, edits, []


class Search:
    """The survivors of one conversation, or of a range of it, from a given state on."""

    def __init__(self, start: int = START):
        self.survivors: tuple = ((start, 0),)
        self.root = Node(None, "")
        self.leaves = [self.root]
        self.cost = 0
        self.unresolved = 0

    def add(self, code: int) -> Iterator[str]:
        """Take a row; the edits of rows, from the first on, that are now the same on all paths."""
        old = self.leaves
        self.survivors, least, came_from = step(self.survivors, code)
        self.cost += least
        self.leaves = []
        for place, edits in came_from:
            node = Node(old[place], edits)
            old[place].kids.append(node)
            self.leaves.append(node)
        for node in old:
            while node is not self.root and not node.kids:
                node.parent.kids.remove(node)
                node = node.parent
        self.unresolved += 1
        root = self.root
        while len(root.kids) == 1:
            (root,) = root.kids
            root.parent = None
            self.unresolved -= 1
            self.root = root
            yield root.edits

    def _rest(self, leaf: Node) -> list[str]:
        out = []
        while leaf is not self.root:
            out.append(leaf.edits)
            leaf = leaf.parent
        return out[::-1]

    def exits(self) -> dict[int, tuple[int, list[str]]]:
        """For each state that survives: the cost of its path and the edits of the unresolved rows."""
        return {
            state: (self.cost + cost, self._rest(leaf)) for (state, cost), leaf in zip(self.survivors, self.leaves)
        }

    def finish(self) -> tuple[int, list[str], str]:
        """Cost, edits of the unresolved rows and what is inserted behind the last, when no row follows."""
        ends = [(cost + INSERT * MISSING[state], place, state) for place, (state, cost) in enumerate(self.survivors)]
        cost, place, state = min(ends)
        return self.cost + cost, self._rest(self.leaves[place]), INSERT_LETTER * MISSING[state]


ROLE_OF = {USER: "user", ASSISTANT: "assistant"}


def apply_edits(state: int, edits: str, role: str, text: str) -> Iterator[tuple[int, str, str | None, str | None]]:
    """`(state after, letter, role, text)` of each edit of one row; a deleted turn has no role and no text."""
    for letter in edits:
        if letter == DELETE_LETTER:
            yield state, letter, None, None
        elif letter == KEEP_LETTER:
            state = MOVES[state][INITIALS[role[0]]]
            yield state, letter, role, text
        else:
            state = ONWARD[state]
            yield state, letter, ROLE_OF[state], text if letter == REROLE_LETTER else ""


class Digest:
    """Audit and hash of a repaired conversation, edit by edit."""

    def __init__(self):
        self.letters, self.hash, self.empty = bytearray(), hashlib.sha256(), True

    def add(self, letter: str, role: str | None, text: str | None) -> None:
        self.letters += letter.encode()
        if role is not None:
            self.hash.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
            self.empty = False

    def result(self) -> tuple[str, str]:
        return self.letters.decode(), self.hash.hexdigest()


EMPTY_HASH = hashlib.sha256().hexdigest()


def _repaired(rows: Iterable[tuple]) -> Iterator[tuple[int, int, str, str | None, str | None]]:
    """`(row, edit, letter, role, text)` for one conversation given as `(code, copies, role, text)`, and last the cost."""
    search, waiting, number, state = Search(), deque(), 0, START

    def settle(edits: str):
        nonlocal number, state
        role, text = waiting.popleft()
        for i, (state, letter, new_role, new_text) in enumerate(apply_edits(state, edits, role, text)):
            yield number, i, letter, new_role, new_text
        number += 1

    for code, copies, role, text in rows:
        for copy in range(copies):
            waiting.append((role, text if copy == 0 else ""))
            for edits in search.add(code if copy == 0 else code_of(OTHER, True, False)):
                yield from settle(edits)
    cost, rest, last = search.finish()
    for edits in rest:
        yield from settle(edits)
    for i, (_, letter, role, text) in enumerate(apply_edits(state, last, "", "")):
        yield number, i, letter, role, text
    yield cost, 0, "", None, None


def _initial(role: Column) -> Column:
    return F.left(role, F.lit(1))


def judge_rows(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copies_col: str | None = None,
) -> DataFrame:
    """Equal rows as one, with their faults: `conv`, `turn`, `role`, `text`, `copies`, `blank`, `duplicate`, `truncated`, `code`.

    Each line of `rows` is one row, or as many as `copies_col` says. A row is a duplicate if its role and text stand in an earlier
    turn of the conversation; all copies but the first are. Texts are compared by SHA-256.
    """
    copies = F.col(copies_col) if copies_col else F.lit(1)
    named = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        copies.cast("long").alias("copies"),
    )
    distinct = named.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    distinct = materialize(distinct.withColumn("said", F.unhex(said)))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    again = distinct.groupBy("conv", "said").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv").alias("again_conv"), F.col("said").alias("again_said"), "first")
    joined = distinct.join(again, F.col("conv").eqNullSafe(F.col("again_conv")) & (F.col("said") == F.col("again_said")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    later = F.coalesce(place > F.col("first"), F.lit(False))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    flagged = joined.select("conv", "turn", "role", "text", "copies", blank.alias("blank"), (later & ~blank).alias("duplicate"))
    flagged = flagged.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & cut)
    initial = F.lit(OTHER)
    for letter, number in INITIALS.items():
        initial = F.when(_initial(F.col("role")) == letter, number).otherwise(initial)
    must_go = (F.col("blank") | F.col("duplicate")).cast("int")
    return flagged.withColumn("code", initial + 4 * must_go + 8 * F.col("truncated").cast("int"))


ORDER = ("conv", "turn", "role", "text")
EDITS = "turn_row long, turn_edit int, edit string, role string, text string"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "blank", "duplicate", "truncated", "code")))


def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


class Counts:
    """Faults and gaps of a stream of judged rows, in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last_turn = self.last_initial = None

    def add(self, turn, role, copies, blank, duplicate, truncated) -> None:
        self.blank += copies * blank
        self.duplicate += duplicate + (copies - 1) * (not blank)
        self.truncated += truncated
        initial = role[:1]
        if self.last_initial is not None:
            self.illegal += not _legal(self.last_initial, initial)
        self.illegal += copies - 1  # a role never follows itself
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn

    def gaps(self) -> int:
        return self.last_turn - self.least + 1 - self.turns if self.turns else 0


def _report(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for conv, rows in groupby(_stream(batches), itemgetter(0)):
            counts, digest, cost = Counts(), Digest(), 0

            def counted():
                for _, turn, role, text, copies, blank, duplicate, truncated, code in rows:  # noqa: B023
                    counts.add(turn, role, copies, blank, duplicate, truncated)  # noqa: B023
                    yield code, copies, role, text

            for row, _, letter, role, text in _repaired(counted()):
                if letter:
                    digest.add(letter, role, text)
                else:
                    cost = row
            found = (counts.gaps(), counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost)
            held.append((conv, *found, *digest.result()))
            if len(held) >= 1000:
                yield _batch(held, kind)
                held = []
        if held:
            yield _batch(held, kind)

    return run


_REPORT_KINDS = [pa.int64()] * 6 + [pa.string()] * 2
_REPORT_NAMES = [part.split()[0] for part in REPORT.split(", ")]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), [kind, *_REPORT_KINDS])]
    return pa.RecordBatch.from_arrays(columns, names=["conv", *_REPORT_NAMES])


def _edited(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for conv, rows in groupby(_stream(batches), itemgetter(0)):
            for edit in _repaired((code, copies, role, text) for _, _, role, text, copies, _, _, _, code in rows):
                if edit[2]:
                    held.append((conv, *edit))
                    size += len(edit[4] or "")
                if len(held) >= 10_000 or size > RANGE_BYTES // 4:
                    yield _edit_batch(held, kind)
                    held, size = [], 0
        if held:
            yield _edit_batch(held, kind)

    return run


def _edit_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = ["conv", *(part.split()[0] for part in EDITS.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class Judged:
    """Judged rows, the many conversations that fit a task and the few that are cut into ranges."""

    def __init__(self, judged: DataFrame, range_rows: int = RANGE_ROWS, range_bytes: int = RANGE_BYTES):
        self.rows = materialize(judged)
        self.type = self.rows.schema["conv"].dataType.simpleString()
        self.parts = parallelism(judged)
        size = F.octet_length("text") + F.octet_length("role")
        sizes = self.rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(size).alias("bytes"))
        long = materialize(sizes.filter((F.col("n") > range_rows) | (F.col("bytes") > range_bytes)))
        ranges = F.sum(F.greatest(F.col("n") / range_rows, F.col("bytes") / range_bytes))
        self.ranges = math.ceil(long.agg(ranges).first()[0] or 0)
        same = F.col("conv").eqNullSafe(F.col("long_conv"))
        names = long.select(F.col("conv").alias("long_conv"))
        self.short = self.rows.join(names, same, "left_anti") if self.ranges else self.rows
        self.long = self.rows.join(names, same, "left_semi") if self.ranges else None

    def streamed(self) -> DataFrame:
        return self.short.repartition(self.parts, "conv").sortWithinPartitions(*ORDER)

    def arrow_kind(self) -> pa.DataType:
        return to_arrow_type(self.rows.schema["conv"].dataType)


def _search_range(table: pa.Table) -> Iterator[tuple]:
    """Per conversation of one range: the search from each of the four states, and the initials at both ends."""
    rows = table.sort_by("pos")
    columns = (rows.column(c).to_pylist() for c in ("conv", "copies", "code", "initial"))
    for conv, part in groupby(zip(*columns), itemgetter(0)):
        searches = [Search(start) for start in range(4)]
        resolved = [[] for _ in searches]
        first = last = None
        illegal = 0
        for _, copies, code, initial in part:
            if first is None:
                first = initial
            else:
                illegal += not _legal(last, initial)
            illegal += copies - 1
            last = initial
            for copy in range(copies):
                now = code if copy == 0 else code_of(OTHER, True, False)
                for search, done in zip(searches, resolved):
                    done.extend(search.add(now))
        for start, (search, done) in enumerate(zip(searches, resolved)):
            exits = search.exits()
            yield (
                conv,
                start,
                ",".join(done),
                [exits[s][0] if s in exits else None for s in range(4)],
                [",".join(exits[s][1]) if s in exits else None for s in range(4)],
                first,
                last,
                illegal,
            )


SEARCHED = "start int, done string, costs array<long>, rests array<string>, first string, last string, illegal long"


def _chain(rows: list[dict]) -> tuple[int, int, list[tuple[int, int, str, str]]]:
    """Cost, illegal pairs, and (part, state at its start, unresolved edits, edits at the end) of one conversation's ranges."""
    parts = sorted({r["part"] for r in rows})
    by_place = {(r["part"], r["start"]): r for r in rows}
    to_go = [[INSERT * m for m in MISSING]]
    for part in reversed(parts):
        after = to_go[-1]
        to_go.append(
            [
                min(c + a for c, a in zip(by_place[part, s]["costs"], after) if c is not None)
                for s in range(4)
            ]
        )
    to_go.reverse()
    state, out, illegal, last = START, [], 0, None
    for i, part in enumerate(parts):
        found, after = by_place[part, state], to_go[i + 1]
        ends = [INSERT_LETTER * m if i + 1 == len(parts) else "" for m in MISSING]
        _, rest, onward = min(
            (c + after[s], r.replace(",", "") + ends[s], s)
            for s, (c, r) in enumerate(zip(found["costs"], found["rests"]))
            if c is not None
        )
        out.append((part, state, found["rests"][onward], ends[onward]))
        illegal += found["illegal"] + (last is not None and not _legal(last, found["first"]))
        state, last = onward, found["last"]
    return to_go[0][START], illegal, out


def _long_edits(judged: Judged) -> tuple[DataFrame, DataFrame]:
    """`(conv, cost, illegal)` and the edits of the conversations that are cut into ranges."""
    kind, arrow = judged.type, judged.arrow_kind()
    placed = judged.long.repartitionByRange(max(1, judged.ranges), *ORDER).sortWithinPartitions(*ORDER)
    placed = materialize(placed.withColumn("pos", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("pos", 33))

    def search(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = [(part, *row) for row in _search_range(table)]
        kinds = [pa.int64(), arrow, pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64()]
        names = ["part", "conv", "start", "done", "costs", "rests", "first", "last", "illegal"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    narrow = placed.select("part", "pos", "conv", "copies", "code", _initial(F.col("role")).alias("initial"))
    searched = materialize(narrow.groupBy("part").applyInArrow(search, f"part long, conv {kind}, {SEARCHED}"))

    def chain(table: pa.Table) -> pa.Table:
        conv = table.column("conv")[0].as_py()
        cost, illegal, ways = _chain(table.to_pylist())
        rows = [(conv, part, start, rest, end, cost, illegal) for part, start, rest, end in ways]
        kinds = [arrow, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv", "part", "start", "rest", "end", "cost", "illegal"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # One row per range and state: without the resolved edits, few bytes each.
    schema = f"conv {kind}, part long, start int, rest string, end string, cost long, illegal long"
    ways = materialize(searched.drop("done").groupBy("conv").applyInArrow(chain, schema))
    totals = ways.select("conv", "cost", "illegal").distinct()
    done = searched.select(
        F.col("part").alias("d_part"), F.col("conv").alias("d_conv"), F.col("start").alias("d_start"), "done"
    )
    same = (F.col("part") == F.col("d_part")) & F.col("conv").eqNullSafe(F.col("d_conv")) & (F.col("start") == F.col("d_start"))
    plans = ways.join(done, same).select("conv", "part", "start", "done", "rest", "end")

    def apply(rows: pa.Table, plan: pa.Table) -> pa.Table:
        plans = {p["conv"]: p for p in plan.to_pylist()}
        rows = rows.sort_by("pos")
        out = []
        columns = (rows.column(c).to_pylist() for c in ("conv", "pos", "role", "text", "copies"))
        for conv, part in groupby(zip(*columns), itemgetter(0)):
            p = plans[conv]
            edits = iter([e for e in (*p["done"].split(","), *p["rest"].split(",")) if e])
            state, last = p["start"], 0
            for _, pos, role, text, copies in part:
                n = 0
                for _ in range(copies):
                    for state, letter, new_role, new_text in apply_edits(state, next(edits), role, text):
                        out.append((conv, pos, n, letter, new_role, new_text))
                        n += 1
                last = pos
            for state, letter, new_role, new_text in apply_edits(state, p["end"], "", ""):
                out.append((conv, last, n, letter, new_role, new_text))
                n += 1
        return pa.Table.from_batches([_edit_batch(out, arrow)])

    edits = placed.groupBy("part").cogroup(plans.groupBy("part")).applyInArrow(apply, f"conv {kind}, {EDITS}")
    return totals, edits


def _digest(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "edit", "role", "text")))

        for conv, edits in groupby(rows(), itemgetter(0)):
            digest = Digest()
            for _, letter, role, text in edits:
                digest.add(letter, role, text)
            audit, sha = digest.result()
            columns = [pa.array([conv], kind), pa.array([audit]), pa.array([sha])]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "audit", "repaired_sha256"])

    return run


def repair(conversations: DataFrame, range_rows: int = RANGE_ROWS, range_bytes: int = RANGE_BYTES, **columns: str) -> DataFrame:
    """Every edit of the cheapest repair: `conv`, `turn_row`, `turn_edit`, `edit` (K, R, D or I), `role`, `text`.

    The repaired conversation is its rows with a role, in the order of `turn_row` and `turn_edit`. Rows stand in the order of their
    turns (NULL first), then role and text; repeated rows follow each other. NULL roles and texts count as one
    space, NULL ids are one conversation, an empty table gives no rows. Other columns are not read. Blank rows and
    duplicates are deleted; a conversation may lose all its rows.
    """
    judged = Judged(judge_rows(conversations, **columns), range_rows, range_bytes)
    edits = judged.streamed().mapInArrow(_edited(judged.arrow_kind()), f"conv {judged.type}, {EDITS}")
    return edits.union(_long_edits(judged)[1]) if judged.ranges else edits


def report(conversations: DataFrame, range_rows: int = RANGE_ROWS, range_bytes: int = RANGE_BYTES, **columns: str) -> DataFrame:
    """One row per conversation that has rows: `conv`, counts of faults, `cost`, `audit`, `repaired_sha256`; see `repair`.

    The hash of a conversation is one stream, so its repaired turns pass through one task, row by row; all else
    is spread over ranges.
    """
    judged = Judged(judge_rows(conversations, **columns), range_rows, range_bytes)
    arrow = judged.arrow_kind()
    short = judged.streamed().mapInArrow(_report(arrow), f"conv {judged.type}, {REPORT}")
    if not judged.ranges:
        return short
    totals, edits = _long_edits(judged)
    digests = (
        materialize(edits)
        .repartition(judged.parts, "conv")
        .sortWithinPartitions("conv", "turn_row", "turn_edit")
        .mapInArrow(_digest(arrow), f"conv {judged.type}, audit string, repaired_sha256 string")
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = judged.long.groupBy("conv").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - 1 + F.col("duplicate").cast("long"))).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )
    named = [t.withColumnRenamed("conv", f"conv{i}") for i, t in enumerate((totals, digests))]
    long = counts
    for i, table in enumerate(named):
        long = long.join(table, F.col("conv").eqNullSafe(F.col(f"conv{i}")))
    return short.unionByName(long.select("conv", *_REPORT_NAMES))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows spoilt by a checksum of `conv_id:turn`: dropped, emptied, cut off, repeated (`_copies`) or given to the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return conversations.filter(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(filled("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("_copies"),
    )


def op12_conversation_repair(spark, sf_dir: str, **limits: int) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = report(damage(conversations), copies_col="_copies", **limits)
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = {"audit": F.lit(""), "repaired_sha256": F.lit(EMPTY_HASH)}
    return joined.select("conv_id", *(F.coalesce(c, zero.get(c, F.lit(0).cast("long"))).alias(c) for c in _REPORT_NAMES))
