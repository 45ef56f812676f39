"""Every query of the subpackage on the smallest tables."""

from pathlib import Path

import pytest
from conftest import SF

from tundra.llm import queries as Q

COLUMNS = {"p3_found": ["field_name", "name_a", "name_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "lang"]}


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.count() > 0
    assert df.columns == COLUMNS.get(name, df.columns)
