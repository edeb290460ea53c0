"""Every registered query against its SQL, and the shape of those without SQL."""

from __future__ import annotations

import pytest
from compare import assert_same, connect
from conftest import DATA

import __spark_entry__ as registry

SF = str(DATA / "sf0.01")
WITH_SQL = sorted(registry.ORACLE)
WITHOUT_SQL = {
    "score_corpus": ["doc_id", "source", "score", "int_score"],
    "train_tanh_layer": ["accuracy", "best", "f1_macro", "loss", "precision", "recall", "step"],
}


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_is_listed():
    assert set(registry.QUERIES) == set(WITH_SQL) | set(WITHOUT_SQL)
    assert set(registry.queries()) >= set(registry.QUERIES)


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, connection, name):
    assert assert_same(registry.queries()[name](spark, SF), connection, registry.oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_rows_only(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns == WITHOUT_SQL[name]
    assert df.count() > 0


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert rows
    assert all(row.int_score >= 3 for row in rows)
    assert len({row.doc_id for row in rows}) == len(rows)
