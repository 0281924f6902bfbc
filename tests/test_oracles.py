from pathlib import Path

import pytest
from oracle import compare, views

from tempograph import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF, plans.queries()[name], plans.oracle_sql()[name]) == ""


#: Queries that SQL can't express, and what tests them.
OWN_TESTS = {"j7_vector_index": "test_scale_forms.py::test_vector_index_recall"}


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(plans.queries()) == set(plans.oracle_sql()) | set(OWN_TESTS)
    for name, where in OWN_TESTS.items():
        file, test = where.split("::")
        assert f"def {test}(" in (Path(__file__).parent / file).read_text(), name
