"""Spelling variants, conversation repair and sharding against plain implementations, with nulls, ties and clashing names."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute
import numpy as np
import pytest
from compare import assert_same, connect
from conftest import DATA

import __spark_entry__ as registry
from cribado.llm import dialogues, sharding, variants

SF = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_conversation_repair"])
def test_query_equals_sql(spark, name):
    assert assert_same(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) > 0


def test_long_conversations_equal_sql(spark):
    """Every conversation above three rows cut into ranges, several of which hold no whole conversation."""
    name = "op12_conversation_repair"
    found = registry.queries()[name](spark, SF, range_rows=3)
    assert assert_same(found, connect(SF), registry.oracle_sql()[name]) > 0


@pytest.mark.parametrize("range_words", [100_000, 7])
def test_variants_equal_plain(spark, range_words):
    rng = random.Random(4)
    counts = Counter()
    for _ in range(150):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))
        counts[word] += rng.choice((1, 2, 30, 500))
    counts.update({"": 5, "a" * 3000: 2, "a" * 2999: 40, "𝒳b": 3, "b": 60, "𝒳": 900, "aab" * 300: 1, "ab" + "aab" * 299: 11})
    rows = [(w, n, -1, "x") for w, n in counts.items()] + [(None, 3, 0, "x"), ("b", None, 0, "x")]
    df = spark.createDataFrame(rows, "word string, n long, id long, form string").repartition(5)
    found = {r.word: tuple(r)[1:] for r in variants.group_variants(df, range_words=range_words).collect()}
    assert found == brute.word_forms(counts)
    assert any(root not in (word, form) for word, (form, root, *_) in found.items())


def test_variants_of_repeated_and_no_words(spark):
    df = spark.createDataFrame([("abc", 4), ("abc", 6), ("abd", 1)], "word string, n long")
    assert {tuple(r) for r in variants.group_variants(df).collect()} == {
        ("abc", None, "abc", 10, 1, None),
        ("abd", "abc", "abc", 1, 1, 10),
    }
    assert variants.group_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants.group_variants(df, ratio=1)


def test_words_of_odd_texts(spark):
    rows = [(1, "Straße ÀÉÎabcd Letters letters LETTERS×y"), (2, None), (None, "letters, letters"), (3, ""), (3, "x" * 9000 + " " + "X" * 9000)]
    docs = spark.createDataFrame([(*r, 7, "w") for r in rows], "doc_id long, text string, n long, word string")
    assert {tuple(r) for r in variants.count_words(docs).collect()} == {("letters", 4), ("x" * 9000, 2)}
    spoiled = Counter(brute.spoiled_words(rows))
    expected = {(w, n) for w, n in spoiled.items() if n >= 2 and len(w) >= 7}
    assert {tuple(r) for r in variants.count_words(docs, spoiled=True).collect()} == expected
    many = [(i, "elephant giraffes penguins crocodile") for i in range(300)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    spoiled = {(w, n) for w, n in Counter(brute.spoiled_words(many)).items() if n >= 2 and len(w) >= 7}
    assert {tuple(r) for r in variants.count_words(df, spoiled=True).collect()} == spoiled and len(spoiled) > 4


ROLES = ["user", "assistant", "system", "tool", "", None]


def _conversations(seed: int, size: int) -> list[tuple]:
    """Rows of a few conversations, with nulls, equal turns and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for conv in (1, 2, 3, None, 5, 6):
        texts = ["Yes.", "no", " ", None, "A b!", "c?\t\n", "é " * 5 + "."]
        for turn in range(rng.randint(1, size)):
            role = rng.choice(ROLES) if rng.random() < 0.4 else ROLES[turn % 2]
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, 3, 10]), role, rng.choice(texts) if rng.random() < 0.6 else f"t{turn}."))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, code long, conv string, copies string"


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("range_rows", [50_000, 4])
def test_repair_equals_plain(spark, seed, range_rows):
    rows = _conversations(seed, 12)
    df = spark.createDataFrame([(*r, 1, "c", "d") for r in rows], SCHEMA).repartition(6)
    found = {r.conv: tuple(r)[1:] for r in dialogues.report(df, range_rows).collect()}
    plain = brute.repaired_conversations(rows)
    assert found == {c: v[:8] for c, v in plain.items()}
    edits = dialogues.repair(df, range_rows).orderBy("conv", "turn_row", "turn_edit").collect()
    for conv, (*_, audit, sha, turns) in plain.items():
        mine = [r for r in edits if r.conv == conv]
        assert "".join(r.edit for r in mine) == audit
        assert [(r.role, r.text) for r in mine if r.role is not None] == turns
        assert sha == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def test_repair_of_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dialogues.report(df).count() == dialogues.repair(df).count() == 0


def test_survivors_coalesce():
    """What is unresolved stays short however long the conversation is, unless an early edit hangs on the end."""
    rng = random.Random(1)
    for weights in ((1, 8, 8, 1), (0, 1, 0, 0), (0, 1, 1, 0), (0, 0, 0, 1)):
        search, longest, settled = dialogues.Search(), 0, 0
        for _ in range(20_000):
            code = rng.choices(range(4), weights)[0] | rng.choice((0, 0, 0, 4, 8))
            settled += sum(1 for _ in search.add(code))
            longest = max(longest, search.unresolved)
        assert settled + search.unresolved == 20_000
        assert longest < 200 or weights == (0, 0, 0, 1)


def test_every_prefix_is_cheapest_and_first():
    """The search against all sequences of edits, row by row, from each state."""
    rng = random.Random(2)
    for _ in range(300):
        codes = [rng.randrange(4) | rng.choice((0, 0, 4, 8)) for _ in range(rng.randint(0, 9))]
        search = dialogues.Search()
        done = [e for code in codes for e in search.add(code)]
        cost, rest, last = search.finish()
        assert ("".join([*done, *rest]) + last, cost) == brute.cheapest_edits(codes)


def test_shards_of_documents(spark):
    rows = registry.queries()["op13_sharding"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {
        (i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()
    }
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    by_shard: dict = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    assert sorted(by_shard) == list(range(24))
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    loads = sorted(sum(r["size"] for r in m) for m in by_shard.values())
    largest = max(r["size"] for r in rows)
    assert loads[-1] <= max(largest, 1.1 * sum(loads) / 24) and loads[-1] - loads[0] <= largest
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(i % 40 if i % 3 else None, None if i % 7 == 0 else "é" * (i % 50), -1, 5, "k") for i in range(3000)]
    rows += [(9, "same", -1, 5, "k")] * 500 + [(10, "x" * 400_000, -1, 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long, shard long, size string").repartition(9)
    found = sharding.place_records(df, 5, slots=512, path=str(tmp_path / "map")).collect()
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((i, len((t or "").encode()) + 8) for i, t, *_ in rows)
    for shard in range(5):
        places = [r.slot for r in found if r.shard == shard]
        assert sorted(places) == list(range(len(places)))
    versions = spark.read.parquet(str(tmp_path / "map")).groupBy("version").count().collect()
    assert sorted(map(tuple, versions)) == [(0, 512), (1, 512)]
    latest = {r.slot: r.shard for r in sharding.read_map(spark, str(tmp_path / "map")).collect()}
    assert all(latest[r.virtual_slot] == r.shard for r in found)
    assert sharding.place_records(df.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        sharding.first_map(9, 8)


@pytest.mark.parametrize("seed", range(3))
def test_maps_are_edited_evenly(seed):
    rng = np.random.default_rng(seed)
    load = rng.pareto(1.5, 4096).round(3) * 1000 // 1
    load = load.astype(np.int64)
    before = sharding.first_map(24, 4096)
    after = sharding.rebalance(before, load, 24)
    total = np.bincount(after, load, 24)
    assert total.max() - total.min() <= max(2, 0.001 * total.mean()) or total.max() == load.max()
    assert (before == after).mean() > 0.5  # edited, not dealt anew
    grown = sharding.grow(after, load, 24)
    assert set(grown[grown != after]) == {24}
    new = np.bincount(grown, load, 25)
    assert 0.9 * load.sum() / 25 <= new[24] <= load.sum() / 25
    assert (sharding.rebalance(before, np.zeros(4096), 24) == before).all()
