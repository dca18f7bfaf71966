import pytest

from tests import oracle
from ticketloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    oracle.assert_same(spark, name, queries.QUERIES[name], queries.SQL[name])


def test_found_columns(spark):
    # The columns of the results that are compared from outside.
    want = {
        "p4_found": {"issue_id": "bigint", "field_name": "string", "pii_type": "string"},
        "p5_found": {"issue_id": "bigint"},
        "p6_found": {"issue_id": "bigint", "line_no": "bigint"},
        "p7_found": {"issue_id": "bigint", "markup_kind": "string"},
        "p8_found": {"item_id": "bigint", "doc_id": "bigint"},
    }
    for name, types in want.items():
        df = queries.QUERIES[name](spark, oracle.DATA)
        assert dict(df.dtypes) == types, name
        assert df.count() == df.distinct().count() > 0, name


def test_nothing_outside_imports_the_package():
    from pathlib import Path

    root = Path(__file__).parents[2] / "ticketloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "ticketloom.llm" not in p.read_text(encoding="utf-8"), p
