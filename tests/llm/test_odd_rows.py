"""Rows that are hard on the operators: words of regular structure, missing and repeated ids, clashing names, many matches."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cribado.llm import mixing, personal, shingles, substrings, topk, warc
from cribado.llm.ppm import score_texts


def by_id(df, *columns):
    return {row[0]: tuple(row)[1:] for row in df.select("doc_id", *columns).collect()}


def _morse(length: int) -> tuple[str, str]:
    """A Thue-Morse word and its complement: equal under any polynomial hash modulo 2^64 with an odd base."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("length", [200, 1024, 4096])
def test_words_of_regular_structure_stay_apart(spark, length):
    one, other = _morse(length)
    rows = []
    for i, word in enumerate((one, other)):
        rows.append((i + 1, f"w1 w2 w3 w4 {word} " + " ".join(f"x{i}y{k}" for k in range(3))))
        rows.append((i + 11, " ".join([*(f"v{k}" for k in range(10)), word, *(f"u{k}" for k in range(9))])))
        rows.append((i + 21, f"{word} a b"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert by_id(shingles.jaccard_components(df), "n_shingles", "component_id") == brute.shingle_components(rows)
    assert by_id(substrings.dedup_windows(df), "n_words", "n_removed", "kept_sha256") == brute.window_removal(rows)
    scores = by_id(score_texts(df), "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    for i, expected in brute.unigram_scores(rows).items():
        assert scores[i][:4] == expected[:4] and scores[i][4] == pytest.approx(expected[4])


CLASHING = "doc_id long, text string, source string, lang string, n_chars long, row string, number long, key0 long, copies long, hits string"
CLEAN = "Numbers rise and fall while rivers run to the sea and birds return each spring to build their nests again " + " ".join(
    f"for reason {k} that nobody knew" for k in range(9)
)


def _rows():
    texts = [CLEAN + f" in {place} with much else to tell" for place in ("Lima", "Oslo", "Rome")]
    rows = [(None, texts[0]), (None, texts[0]), (None, "something else entirely from all the other rows here"), (1, texts[1]), (1, "another text under one id")]
    rows += [(2, texts[2]), (2, texts[2]), (3, None), (3, None), (4, ""), (None, None), (5, "call +34 911 222 333 or me@x.org")]
    return [(i, t, None if n % 4 == 3 else f"s{n % 3}", "es", len(t or ""), f"r{n % 2}", n % 2, 7, 8, "h") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd_rows(spark):
    return spark.createDataFrame(_rows(), CLASHING).repartition(3)


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_one_of_each_group_stays_row_by_row(spark, odd_rows):
    kept = shingles.keep_one(odd_rows)
    assert kept.columns == odd_rows.columns
    rows, given = [tuple(r) for r in kept.collect()], _rows()
    apart = [r for r in given if not (r[1] or "").startswith(CLEAN)]
    assert _sorted(r for r in rows if not (r[1] or "").startswith(CLEAN)) == _sorted(apart)
    family = [r for r in rows if (r[1] or "").startswith(CLEAN)]
    assert len(family) == 1 and family[0][0] == 1  # the smallest id; rows without one come last
    nameless = odd_rows.withColumn("doc_id", F.lit(None).cast("long"))
    assert shingles.keep_one(nameless).count() == len(apart) + 1
    assert shingles.keep_one(odd_rows.limit(0)).count() == 0


def test_rows_are_repeated_by_their_own_number(spark, odd_rows):
    mixed = mixing.repeat_documents(odd_rows)
    assert mixed.columns == odd_rows.columns
    numbers = mixing.mix(odd_rows).groupBy("source").agg(F.sum(F.col("copies")).alias("n"), F.sum("copies")).collect()
    taken = {r.source: r.n for r in numbers if r.n}
    assert {r.source: r["count"] for r in mixed.groupBy("source").count().collect()} == taken
    assert {tuple(r) for r in mixed.collect()} <= set(_rows())
    assert mixing.repeat_documents(odd_rows.limit(0)).count() == 0
    many = spark.createDataFrame([(None if i % 2 else 4, f"w{i % 50} b c", "s") for i in range(1000)], "doc_id long, text string, source string")
    assert abs(mixing.repeat_documents(many).count() - 1500) <= 2


def test_mix_takes_what_prefix_sums_say(spark):
    """The whole query against a plain run over the rows in their order."""
    import __spark_entry__ as registry
    from conftest import DATA

    rows = registry.queries()["op9_mixing"](spark, str(DATA / "sf0.001")).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).collect()}
    order = spark.createDataFrame([(i,) for i in docs], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()
    hashes = {r.doc_id: r.h for r in order}
    starts = spark.createDataFrame([(r.source,) for r in docs.values()], "s string").distinct()
    starts = {r.s: r.o for r in starts.select("s", (F.pmod(F.xxhash64("s", F.lit(42)), F.lit(1 << 20)) / float(1 << 20)).alias("o")).collect()}
    sizes = {i: len(brute.WORD.findall(d.text or "")) for i, d in docs.items()}
    total = Counter()
    for i, d in docs.items():
        total[d.source] += sizes[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    full, level = set(), 0.0
    while True:  # what stands above twice a source's size is shared among the others
        left = 1.5 * sum(total.values()) - sum(2.0 * total[s] for s in full)
        level = left / max(sum(weight[s] for s in names if s not in full), 1)
        over = {s for s in names if s not in full and level * weight[s] >= 2.0 * total[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * total[s] if s in full else level * weight[s] for s in names}
    found = {r.doc_id: (r["size"], r.source_size, r.taken) for r in rows}
    for s in names:
        own = sorted((i for i, d in docs.items() if d.source == s), key=lambda i: (sizes[i], hashes[i], i))
        each = target[s] / total[s] if total[s] else 0.0
        for place, i in enumerate(own):
            copies = int((place + 1) * each + starts[s]) - int(place * each + starts[s])
            assert found[i] == (sizes[i], total[s], copies * sizes[i])
    assert all(r.target == pytest.approx(target[docs[r.doc_id].source]) for r in rows)


def test_redaction_keeps_rows_and_names(spark, odd_rows):
    cleaned = personal.redact(odd_rows)
    assert cleaned.columns == odd_rows.columns
    expected = [(*r[:1], "call [PHONE] or [EMAIL]", *r[2:4], 23, *r[5:]) if r[0] == 5 else r for r in _rows()]
    assert _sorted(cleaned.collect()) == _sorted(expected)
    assert personal.redact(odd_rows.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.com 10.0.{i % 256}.7" for i in range(5000)) + " é" * 1500
    rows = [(1, text), (2, "call 555-123-4567 now"), (3, "call 555-123-4567 now +1"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in personal.detect(docs).collect()}
    assert [(s.start, s.kind, personal.KINDS[s.kind], s.stop) for s in found[1].base] == brute.personal_spans(text)
    assert found[2].spans == found[3].spans  # whatever else the text holds
    cleaned = {r.doc_id: r.text for r in personal.redact(docs).collect()}
    assert cleaned[1] == "[EMAIL] [IP] " * 4999 + "[EMAIL] [IP]" + " é" * 1500 and cleaned[4] is None


def test_keys_are_found(spark):
    rows = [(i, f'some words here token = "{i:04x}' + "9f3a8b7c6d5e4f3a2b1c0d9e8f7a6b5c" + '" and more') for i in range(60)]
    rows += [(100 + i, f"an ordinary-looking-hyphenated-sentence {i} and antidisestablishmentarianism") for i in range(60)]
    found = personal.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    hits = {r.doc_id for r in found.collect() if r.secrets}
    assert hits == set(range(60))


def test_vectors_without_components(spark):
    df = spark.createDataFrame([(0, []), (1, []), (20, []), (3, [1.0])], "vec_id long, vector array<double>")
    found = topk.search(df.filter("vec_id % 20 = 0"), df, 3).collect()
    assert _sorted(found) == [(0, 1, 1, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]


def test_archives_are_read_side_by_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 20_000)
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"{i} " * 700, "x") for i in range(120)], "page_id long, url string, html string, archive string")
    index = warc.write_archives(pages.repartition(3), str(tmp_path / "w"))
    archives = index.select("archive").distinct().count()
    assert archives > 5
    read = warc.read_archives(index)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() == archives
    assert sorted(r.page_id for r in read.collect()) == list(range(120))
    some = warc.fetch(index.filter("page_id % 10 = 0").union(index.filter("page_id = 50"))).collect()
    assert sorted(r.page_id for r in some) == sorted([*range(0, 120, 10), 50])


def test_stages_on_odd_rows(spark, odd_rows):
    """Every stage in turn: nulls, missing and repeated ids, repeated rows, clashing names, no rows at all."""
    long = " ".join(f"word{k}" for k in range(80))
    rows = spark.createDataFrame([(None if i % 2 else 1, f"{long} number{i // 3} " + long[::-1], "s", "es", 9, "r", 1, 2, 3, "h") for i in range(9)], CLASHING)
    for start in (odd_rows.union(rows), odd_rows.limit(0)):
        docs = start
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
            docs = corpus_pipeline.materialize(stage(spark, docs, ""))
            if number < len(corpus_pipeline.STAGES):
                assert docs.columns == start.columns
        assert (docs.count() > 0) == (start is not odd_rows and start.count() > 0)
