"""Every query outside the llm subpackage against its SQL counterpart, and the driver's contract."""

import re

import pytest

import __spark_entry__ as entry
from assaykit.plans import catalog, preparation
from tests.compare import connect, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    names, expected = sql_rows(connect(small), catalog.SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    assert entry.entry(spark).columns == ["trace_id", "span_id", "parent_span_id", "operation_type"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_the_eight_operators_have_their_names():
    """p1_ to p8_ stand for the data-preparation operators; the check measures the first query of each as the operator."""
    own = set(preparation.QUERIES) | set(entry.llm_queries.QUERIES if entry.llm_queries else ())
    assert {n for n in entry.queries() if re.match(r"p[1-8]_", n)} <= own
