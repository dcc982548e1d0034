import pytest

from assaykit.llm import queries
from tests.compare import connect, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    names, expected = sql_rows(connect(small), queries.SQL[name])
    assert sorted(df.columns) == names and rows_of(df) == expected


@pytest.mark.parametrize(
    ("name", "columns"),
    [("p1_found", ["table_name", "record_id", "defect"]), ("p6_found", ["doc_id", "item_id"]), ("p8_found", ["doc_id"]), ("p7_mix_documents", None), ("p7_mix_shares", None)],
)
def test_others_run(spark, small, name, columns):
    df = queries.QUERIES[name](spark, small)
    assert columns is None or df.columns == columns
    assert df.count() > 0
