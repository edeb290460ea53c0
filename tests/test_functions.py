"""Column functions against literal tables and against Python's own re, str and round."""

from __future__ import annotations

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cribado.functions import responses, scores, text
from cribado.functions.fixed import DOMAIN_PATTERN, RATING_PATTERN, SPACE_CHARS, USE_CASE_PATTERN

QUICK = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def evaluate(spark, values, column, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", column(F.col("v")).alias("r"))
    return [row.r for row in sorted(rows.collect(), key=lambda row: row.i)]


RATINGS = [
    ("PUNTUACIÓN EDUCATIVA: 4", "4", 4),
    ("PUNTUACIÓN EDUCATIVA: 3.7 ok", "3.7", 3),
    ("PUNTUACIÓN EDUCATIVA:\n5.", "5.", 5),
    ("PUNTUACIÓN EDUCATIVA: 12/5", "12", 5),
    ("PUNTUACIÓN EDUCATIVA: .5", ".5", None),
    ("PUNTUACIÓN EDUCATIVA: .", ".", None),
    ("PUNTUACIÓN EDUCATIVA 2 PUNTUACIÓN EDUCATIVA: 5", "2", 2),
    ("PUNTUACIÓN EDUCATIVA:\xa03", "3", 3),
    ("PUNTUACIÓN EDUCATIVA:\x1c3", "3", 3),
    ("PUNTUACIÓN EDUCATIVA: " + "9" * 400, "9" * 400, 5),
    ("PUNTUACIÓN EDUCATIVA: **4**", None, None),
    ("puntuación educativa: 4", None, None),
    ("PUNTUACIÓN EDUCATIVA: -1", None, None),
    ("", None, None),
    (None, None, None),
]


def test_rating_text_and_class(spark):
    raw = evaluate(spark, [r[0] for r in RATINGS], responses.rating_text)
    assert raw == [r[1] for r in RATINGS]
    assert evaluate(spark, raw, scores.rating_class) == [r[2] for r in RATINGS]


LABELS = [
    ("DOMINIO: Salud, Educación\nCASOS DE USO: Telemedicina, Tutoría STEM", "Salud, Educación", "Telemedicina, Tutoría STEM"),
    ("DOMINIO: Salud.\nCASOS DE USO: Telemedicina", None, "Telemedicina"),
    ("DOMINIO: Salud \nCASOS DE USO: a", None, "a"),
    ("DOMINIO: Educación\r\nCASOS DE USO: Tutoría STEM", None, "Tutoría STEM"),
    ('DOMINIO: "Salud"\nCASOS DE USO: Telemedicina', None, "Telemedicina"),
    ("DOMINIO: Salud\nLegal\nCASOS DE USO: a", "Salud\nLegal", "a"),
    ("DOMINIO: Salud, Legal\n\nCASOS DE USO:\n- Telemedicina", "Salud, Legal", None),
    (
        "DOMINIO: Soporte al Cliente\nCASOS DE USO: Servicios Financieros, E-commerce, Telecomunicaciones",
        "Soporte al Cliente",
        "Servicios Financieros, E",
    ),
    (
        "DOMINIO: Sin coincidencia\nCASOS DE USO: Sin coincidencia\nEl texto trata",
        "Sin coincidencia",
        "Sin coincidencia\nEl texto trata",
    ),
    ("DOMINIO: Salud. DOMINIO: Legal\n", "Legal", None),
    ("DOMINIO: Educación\n", None, None),
    (None, None, None),
]


def test_label_lists(spark):
    texts = [r[0] for r in LABELS]
    assert evaluate(spark, texts, responses.domain_list) == [r[1] for r in LABELS]
    assert evaluate(spark, texts, responses.use_case_list) == [r[2] for r in LABELS]


def test_hyphen_option_keeps_the_list_whole(spark):
    value = "DOMINIO: Post-venta\nCASOS DE USO: Servicios Financieros, E-commerce, Telecomunicaciones"
    assert evaluate(spark, [value], lambda c: responses.domain_list(c, True)) == ["Post-venta"]
    assert evaluate(spark, [value], lambda c: responses.use_case_list(c, True)) == [
        "Servicios Financieros, E-commerce, Telecomunicaciones"
    ]


_PIECES = st.sampled_from(
    ["DOMINIO", "CASOS DE USO", "PUNTUACIÓN EDUCATIVA", ":", ",", "\n", " ", "\r", "\xa0", "\x1c", " ", ".", "-", "_"]
    + ["a", "Ñu", "é", "²", "٣", "7", "3.5", "ab c", "x, y", "\n\n", ", ", ",\n"]
)


@QUICK
@given(st.lists(st.lists(_PIECES, max_size=25).map("".join), min_size=60, max_size=60))
def test_patterns_match_as_in_python(spark, tails):
    heads = ["DOMINIO: ", "CASOS DE USO:", "PUNTUACIÓN EDUCATIVA", ""]
    texts = [heads[i % 4] + tail for i, tail in enumerate(tails)]

    def python(pattern):
        return [m.group(1) if (m := re.search(pattern, t)) else None for t in texts]

    assert evaluate(spark, texts, responses.rating_text) == python(RATING_PATTERN)
    assert evaluate(spark, texts, responses.domain_list) == python(DOMAIN_PATTERN)
    assert evaluate(spark, texts, responses.use_case_list) == python(USE_CASE_PATTERN)


def test_a_very_long_response_does_not_overflow(spark):
    items = ", ".join(["uno dos"] * 50_000)
    response = f"DOMINIO: {items}\nCASOS DE USO: {items}"
    assert evaluate(spark, [response], responses.domain_list) == [items]
    assert evaluate(spark, [response], responses.use_case_list) == [items]


QUANTIZED = [
    (-1.2, 0), (-0.5, 0), (0.5, 0), (1.5, 2), (2.4999, 2), (2.5, 2), (3.5, 4), (4.5, 4), (5.5, 5), (7.0, 5),
    (math.nan, 0), (math.inf, 5), (-math.inf, 0), (None, None),
]


def test_int_score(spark):
    assert evaluate(spark, [q[0] for q in QUANTIZED], scores.int_score, "double") == [q[1] for q in QUANTIZED]


@QUICK
@given(st.lists(st.floats(width=32), min_size=100, max_size=100))
def test_int_score_as_in_python(spark, values):
    expected = [int(round(max(0, min(v, 5)))) for v in values]
    assert evaluate(spark, values, scores.int_score, "double") == expected


def test_render_prompt_is_literal(spark):
    render = lambda c: text.render_prompt("P <EJEMPLO> Q <EJEMPLO>", c)
    values = [r"a$1 \ .*", "<EJEMPLO>", None]
    assert evaluate(spark, values, render) == [r"P a$1 \ .* Q a$1 \ .*", "P <EJEMPLO> Q <EJEMPLO>", None]


@QUICK
@given(st.lists(st.text(alphabet=SPACE_CHARS + "ab,", max_size=12), min_size=50, max_size=50))
def test_strip_and_tokens_as_in_python(spark, values):
    assert evaluate(spark, values, text.strip) == [v.strip() for v in values]
    assert evaluate(spark, values, text.tokens) == [v.split() or [""] for v in values]


def test_token_budget(spark):
    values = ["a  b\tc d", "a b", "  x\n y ", "", None]
    assert evaluate(spark, values, lambda c: text.token_budget(c, 3, "first")) == ["a b c", "a b", "  x\n y ", "", None]
    assert evaluate(spark, values, lambda c: text.token_budget(c, 3)) == ["b c d", "a b", "  x\n y ", "", None]
    with pytest.raises(ValueError):
        text.token_budget(F.col("v"), 3, "middle")


def test_dataset_names(spark):
    paths = ["/data/con_ic_et/train.arrow", "train.arrow", "a_b/x.arrow"]
    assert evaluate(spark, paths, text.dataset_of_shard) == ["con-ic-et", None, "a-b"]
    names = evaluate(spark, paths, lambda c: text.result_file(c, F.lit("org/Model-3.1_x")))
    assert names == ["usecasesdomains_con-ic-et_Model-3.1_x.json", None, "usecasesdomains_a-b_Model-3.1_x.json"]
    assert evaluate(spark, ["/out/" + names[0], "plain.json", "usecasesdomains_ds.json"], text.dataset_of_result) == [
        "con-ic-et",
        None,
        "ds",
    ]


def test_linear_score(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    rows = df.select(scores.linear_score(F.col("v"), [0.5, -1.0], 3.0).alias("s")).collect()
    assert [row.s for row in rows] == [1.5, None]


def test_digits_of_other_scripts_are_ratings(spark):
    rows = spark.createDataFrame([("٣",), ("४.५",), ("4",), (".5",)], "raw string")
    assert [r[0] for r in rows.select(scores.rating_class(F.col("raw"))).collect()] == [3, 4, 4, None]


def test_weights_of_another_length_are_an_error(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in rows.select(scores.linear_score(F.col("v"), [1.0, 1.0])).collect()] == [3.0, None]
    with pytest.raises(Exception, match="another length"):
        rows.select(scores.linear_score(F.col("v"), [1.0])).collect()
