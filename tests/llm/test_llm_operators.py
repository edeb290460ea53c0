"""Each operator against a plain implementation: on the small table, and on rows with nulls, ties and clashing names."""

from __future__ import annotations

import hashlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import assert_same, connect
from conftest import DATA

import __spark_entry__ as registry
from cribado.llm import bpe, mixing, personal, quality, shingles, substrings, suffixes, topk, warc
from cribado.llm.components import connected
from cribado.llm.ppm import ORDER, score_texts

SF = str(DATA / "sf0.001")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ODD = [
    (1, PASSAGE + " alpha beta gamma"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, PASSAGE + " alpha beta gamma"),
    (6, "start " + PASSAGE + " alpha beta gamma delta"),
    (7, "Café naïve \U0001f600 日本語 text"),
    (8, "x " * 3000),
    (9, "word"),
    (10, "word"),
    (11, "Word two"),
    (12, (PASSAGE + "\n") * 400),
    (13, "z" * 5000),
    (14, "mail me: jo.doe@mail.example.org or +1 (988) 555-2485 4524132264652876 from 10.1.2.3 not 300.1.2.3.4"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows over several partitions, with columns named like results."""
    rows = [(i, t, "s" if i % 3 else None, -1, -2, "k") for i, t in ODD]
    schema = "doc_id long, text string, source string, n_words long, size long, kept string"
    return spark.createDataFrame(rows, schema).repartition(5, "doc_id")


@pytest.fixture(scope="module")
def small(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


def by_id(df, *columns):
    return {row[0]: tuple(row)[1:] for row in df.select("doc_id", *columns).collect()}


def empty(df):
    return df.limit(0)


QUERY_COLUMNS = {
    "op1_ngram_jaccard": (["n_shingles", "component_id"], brute.shingle_components),
    "op2_suffix_array_dedup": (["n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.substring_removal),
    "op6_substring_dedup": (["n_words", "n_removed", "kept_sha256"], brute.window_removal),
    "op8_pii": (["n_email", "n_ip", "n_card", "n_phone", "base_sha256"], brute.personal_data),
}


@pytest.mark.parametrize("name", sorted(QUERY_COLUMNS))
def test_query_equals_plain(spark, small, name):
    columns, plain = QUERY_COLUMNS[name]
    assert by_id(registry.queries()[name](spark, SF), *columns) == plain(small)


@pytest.mark.parametrize("name", ["op4_exact_topk", "op7_warc", "op10_quality_rules"])
def test_query_equals_sql(spark, name):
    assert assert_same(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) > 0


def test_components_of_odd_rows(odd):
    assert by_id(shingles.jaccard_components(odd), "n_shingles", "component_id") == brute.shingle_components(ODD)
    assert shingles.jaccard_components(empty(odd)).count() == 0
    kept = {r.doc_id for r in shingles.keep_one(odd).collect()}
    assert kept == {i for i, (_, c) in brute.shingle_components(ODD).items() if c == i}


def test_near_copies_link_exactly(spark):
    """A family around one origin, some members too far from it, compared with all pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 7), replace=False):
            words[at] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert by_id(shingles.jaccard_components(df), "n_shingles", "component_id") == brute.shingle_components(rows)


def test_strings_of_odd_rows(odd):
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    expected = brute.substring_removal(ODD)
    assert by_id(suffixes.dedup_strings(odd), *columns) == expected
    assert by_id(suffixes.dedup_strings(odd, hot=2), *columns) == expected
    assert suffixes.dedup_strings(empty(odd)).count() == 0


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, (300, suffixes.WIDTH), dtype=np.uint8)
    after = rng.integers(suffixes.ANCHOR, suffixes.LENGTH + 1, 300).astype(np.uint8)
    data[np.arange(suffixes.WIDTH) >= suffixes.REACH + after[:, None]] = 0
    rows = suffixes.Rows(data, np.full(300, suffixes.REACH, np.uint8), after, np.arange(300))
    ordered = suffixes.Suffixes(rows).sort(np.arange(300), np.array([120, 1, 179]), 10)
    text = [bytes(d[10 : suffixes.REACH + a])[: suffixes.LENGTH] for d, a in zip(data, after.astype(int))]
    for part in (slice(0, 120), slice(121, 300)):
        found = [text[i] for i in ordered[part]]
        assert found == sorted(found)


def test_windows_of_odd_rows(odd):
    columns = ["n_words", "n_removed", "kept_sha256"]
    assert by_id(substrings.dedup_windows(odd), *columns) == brute.window_removal(ODD)
    assert substrings.dedup_windows(empty(odd)).count() == 0


def test_tokens_equal_the_library(odd, small):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.sentencepiece_model(ranks), public_tokenizers.PATTERN)
    odd_texts = ["\x1c \x85a\xa0b", "<|endoftext|> <unk>", "it's 12 ½² '' ''ll", " 　x", "a" * 3000, " " * 999 + "x"]
    texts = [t or "" for _, t in [*ODD, *small]] + odd_texts
    assert [list(ids) for ids in encoder.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]
    encoded = bpe.encode(odd, ranks, public_tokenizers.PATTERN)
    decoded = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(encoded, ranks).collect()}
    assert decoded == {i: t or "" for i, t in ODD}
    assert bpe.encode(empty(odd), ranks, public_tokenizers.PATTERN).count() == 0


def test_token_query_equals_the_library(spark, small, odd):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(rows):
        ids = {i: library.encode_ordinary(t or "") for i, t in rows}
        sha = lambda data: hashlib.sha256(data).hexdigest()
        return {i: (len(ids[i]), sha(" ".join(map(str, ids[i])).encode()), sha((t or "").encode())) for i, t in rows}

    columns = ["n_tokens", "ids_sha256", "decoded_sha256"]
    assert by_id(registry.queries()["op3_byte_bpe"](spark, SF), *columns) == plain(small)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode_and_decode(odd.union(odd.filter("doc_id > 9")), vocabulary, keep_ids=True)
    assert by_id(found, *columns) == plain(ODD) and found.count() == len(ODD) + 5
    assert all(list(r.ids) == library.encode_ordinary(dict(ODD)[r.doc_id] or "") for r in found.collect())
    assert bpe.encode_and_decode(empty(odd), vocabulary).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe.encode_and_decode(nulls, vocabulary).collect()) == [0, 2]


def test_tokens_at_spaces_of_all_kinds(monkeypatch):
    """Parts between spaces encode as the whole does; also when the memory starts anew, and for another pattern."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = bpe.sentencepiece_model(ranks)
    rng = np.random.default_rng(8)
    signs = [" ", " ", " ", "a", "é", "12", "'", "s", "'ll", "\n", "\t", "\r", "\x1c", "\xa0", "\u2003", "!", "日", "the"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(20_000)]
    cautious = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    for pattern, memory in ((public_tokenizers.PATTERN, 300_000), (public_tokenizers.PATTERN, 40), (cautious, 300_000)):
        monkeypatch.setattr(bpe, "REMEMBERED", memory)
        library = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encoder = bpe.Encoder(model, pattern)
        found = [list(ids) for i in range(0, len(texts), 500) for ids in encoder.encode_all(texts[i : i + 500])]
        assert found == [library.encode_ordinary(t) for t in texts]


def test_topk_with_gaps_and_ties(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(40)]
    rows += [(40, None), (41, [None, 1.0]), (42, [float("nan"), 1.0]), (43, [1.0]), (None, [1.0, 1.0]), (44, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = [tuple(r) for r in topk.search(df.filter("vec_id = 5"), df, 4).orderBy("rank").collect()]
    assert found == [(5, 1, 44, 2**63 - 1), (5, 2, 2, 5), (5, 3, 8, 5), (5, 4, 11, 5)]
    assert topk.search(empty(df), df, 3).count() == topk.search(df, empty(df), 3).count() == 0


@pytest.mark.parametrize("tile", [4096, 3])
def test_topk_with_repeated_ids(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE_CANDIDATES", tile)
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [9.0, 1.0])] * 20 + [(i, [float(10 - i), 1.0]) for i in range(2, 9)]
    rows += [(2, [float(-v), 2.0]) for v in range(12)] + [(3, [float(v) / 2 // 1, 3.0]) for v in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    best: dict = {}
    for i, v in rows[3:]:
        best[i] = max(best.get(i, -100), int(v[0]))
    expected = sorted((-score, i) for i, score in best.items())[:4]
    found = topk.search(df.filter("vec_id = 0"), df, 4).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(0, n, i, -score) for n, (score, i) in enumerate(expected, 1)]


def test_topk_over_many_cells(spark, monkeypatch):
    for name, size in {"CELL_QUERIES": 20, "CELL_CANDIDATES": 8, "TILE_QUERIES": 7, "TILE_CANDIDATES": 5, "FAN_IN": 3}.items():
        monkeypatch.setattr(topk, name, size)
    values = np.random.default_rng(1).integers(-4, 5, (300, 6))
    df = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(values)], "vec_id long, vector array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df.filter("vec_id % 10 = 0"), df, 5).collect()}
    scores = values @ values.T
    for q in range(0, 300, 10):
        best = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
        assert [found[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_scores_of_odd_rows(odd):
    rows = by_id(score_texts(odd), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    model = brute.ppm_code_length(ODD, ORDER)
    for i, expected in brute.unigram_scores(ODD).items():
        assert rows[i][:4] == expected[:4]
        assert rows[i][4:] == pytest.approx((expected[4], model[i]), rel=1e-6)
    assert score_texts(empty(odd)).count() == 0


def test_archives(spark, tmp_path):
    long = "<p>" + "a" * 2000
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "http://b", "short"), (4, "http://c", "short"), (5, "u", None)]
    rows += [(6, "u", long + "\r\n\r\nWARC/1.1"), (None, "u", long), (7, "é", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(pages.repartition(2), str(tmp_path / "w"))
    found = {r.page_id: r for r in warc.read_archives(index.select("archive").distinct()).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {
        **{i: ("response", None) for i in (2, 3, 4, 5, 6, 7)},
        1: ("revisit", 2),
        None: ("revisit", 2),
    }
    for page_id, _, html in rows:
        payload = (html or "").encode()
        assert (found[page_id].payload_bytes, found[page_id].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        if found[page_id].record_type == "response":
            assert bytes(found[page_id].payload) == payload
    one = warc.fetch(index.filter("page_id = 6")).collect()
    assert [(r.page_id, bytes(r.payload).decode()) for r in one] == [(6, rows[5][2])]
    assert warc.write_archives(empty(pages), str(tmp_path / "e")).count() == 0


def test_personal_data_of_odd_rows(odd):
    found = personal.detect(odd)
    plain = {i: brute.personal_spans(t) for i, t in ODD}
    for row in found.collect():
        assert [(s.start, s.kind, personal.KINDS[s.kind], s.stop) for s in row.base] == plain[row.doc_id]
        assert set(map(tuple, row.base)) <= set(map(tuple, row.spans))
    assert personal.detect(empty(odd)).count() == 0


def test_addresses_with_zero_parts(spark):
    texts = ["from 10.0.0.1 on", "0.0.0.0", "000.1.1.1", "127.0.0.1 00.00.0.0", "256.1.1.1", "1.1.1.0256", "0300.0.0.0", "0010.0255.1.000"]
    rows = list(enumerate(texts))
    found = personal.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: [(s.start, s.kind, personal.KINDS[s.kind], s.stop) for s in r.base] for r in found.collect()}
    assert spans == {i: brute.personal_spans(t) for i, t in rows}
    assert sum(map(len, spans.values())) == 6


def test_classifier_adds_what_patterns_miss(spark):
    rows = [(i, f"call +1 (988) 555-24{i:02d} or write a{i}@b.com, card 4524132264652876.") for i in range(40)]
    rows += [(50, "+1 (269) 555-3296 4524132264652876 and x"), (51, "token abc071129071368dd"), (52, "é\U0001f600 a@b.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(personal.KINDS[s.kind], s.start, s.stop) for s in r.spans] for r in personal.detect(docs).collect()}
    assert found[50] == [("phone", 0, 17), ("card", 18, 34)]
    assert found[51] == []
    assert found[52] == [("email", 3, 10)]
    text = {r.doc_id: r.text for r in personal.redact(docs).collect()}
    assert text[50] == "[PHONE] [CARD] and x" and text[52] == "é\U0001f600 [EMAIL]"


def test_mix_reaches_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())
    taken, size, target, longest = {}, {}, {}, {}
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        size[r.source] = size.get(r.source, 0) + r.size
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    weights = dict(zip(sorted(size), [3, 1, 2] * 10))
    below = {s: target[s] / weights[s] for s in size if target[s] < 2 * size[s] - 1e-6}
    assert max(below.values()) == pytest.approx(min(below.values()))
    assert all(target[s] == pytest.approx(2 * size[s]) and 2 * size[s] <= weights[s] * max(below.values()) + 1e-6 for s in size if s not in below)
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in size)


def test_mix_of_odd_rows(odd):
    rows = {r.doc_id: r for r in mixing.mix(odd).collect()}
    assert set(rows) == {i for i, _ in ODD} and rows[2]["size"] == 0 and rows[8]["size"] == 3000
    assert mixing.mix(empty(odd)).count() == 0
    assert mixing.repeat_documents(odd).columns == odd.columns


def test_frequent_lines_go(spark, monkeypatch):
    rows = [(i, f"Shared   LINE here {'' if i % 2 else ' '}\n" + " ".join(f"w{i}x{k}" for k in range(80)), "h") for i in range(12)]
    rows += [(20, "shared line here\n" * 30, "h"), (21, "shared line here\n" + " ".join(f"v{k}" for k in range(60)), "other"), (22, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = docs.selectExpr("*", "1 AS host", "2 AS row", "3 AS hits", "4 AS kept", "5 AS line", "6 AS judged", "7 AS found_words")
    results = []
    for limit in (1000, -1):
        monkeypatch.setattr(quality, "BROADCAST_LINES", limit)
        results.append(sorted(tuple(r) for r in quality.judge(docs, max_texts=10).select("doc_id", "kept", "cleaned").collect()))
    assert results[0] == results[1]
    kept = {i: (k, t) for i, k, t in results[0]}
    assert [i for i, (k, _) in kept.items() if not k] == [20, 22]
    assert kept[0][1].startswith("w0x0 ") and kept[21][1].startswith("shared line")
    good = {r.doc_id: tuple(r)[1:] for r in quality.keep_good(clash, max_texts=10).collect()}
    assert good == {i: (t, *r[2:], 1, 2, 3, 4, 5, 6, 7) for i, (k, t) in kept.items() if k for r in rows if r[0] == i}
    nulls = docs.selectExpr("CAST(NULL AS long) AS doc_id", "text", "source")
    nulls = nulls.union(nulls)  # exact copies and rows without ids
    assert quality.keep_good(nulls, max_texts=10).count() == 2 * len(good)
    assert quality.keep_good(empty(docs)).columns == docs.columns and quality.keep_good(empty(docs)).count() == 0


def test_near_copies_do_not_reject_each_other(spark):
    lines = [" ".join(f"word{n}x{k}" for k in range(12)) for n in range(20)]
    rows = [(i, "\n".join([*lines[: i % 20], f"{lines[i % 20]} edit{i}", *lines[i % 20 + 1 :]]), "near") for i in range(150)]
    rows += [(1000 + i, "Subscribe now\n" + " ".join(f"w{i}x{k}" for k in range(80)), "near") for i in range(110)]
    rows += [(2000, "subscribe now\n" * 20 + " ".join(f"v{k}" for k in range(60)), None), (2001, None, "near")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    text = {i: t for i, t, _ in rows}
    kept = {r.doc_id: r.text for r in quality.keep_good(docs).collect()}
    assert {i: kept.get(i) for i in range(150)} == {i: text[i] for i in range(150)}
    assert all(kept[1000 + i] == text[1000 + i].split("\n")[1] for i in range(110))
    assert kept[2000] == text[2000] and 2001 not in kept
    assert quality.judge(docs).filter("doc_id < 150 AND kept").count() == 150
    large = {r.doc_id: r.text for r in quality.keep_good(docs, host_share=0.5).collect()}
    assert large[1000] == text[1000]  # 110 of 260 distinct texts are below half


def test_quality_of_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in quality.judge(odd).collect()}
    assert rows[2].n_words == rows[3].n_words == rows[4].n_words == 0 and rows[2].base_failed
    assert rows[8].n_repeat_words == 3000 and rows[8].base_failed
    assert rows[12].n_dup_lines == 399 and rows[12].n_words == 8000
    assert quality.judge(empty(odd)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    rows = connected(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = stage(spark, docs, SF)
        if number < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        docs = corpus_pipeline.materialize(docs)
    row = docs.first()
    assert row.n_tokens == len(row.ids)
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, row.ids)).encode()).hexdigest()
