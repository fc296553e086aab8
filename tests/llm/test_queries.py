"""Every query of the subpackage runs on the smallest tables with the columns asked for."""

import pytest

from graphloom.llm.queries import ORACLE, QUERIES
from tests.helpers import connect, rows

COLUMNS = {"p3_found": ["file_path"], "p4_found": ["node_id"], "p7_found": ["file_path"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id_a", "doc_id_b"]}


@pytest.mark.parametrize("name", QUERIES)
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", ORACLE)
def test_same_as_sql(spark, sf, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(connect(sf).sql(ORACLE[name]).df())
