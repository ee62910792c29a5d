"""Registered queries against their SQL, and what the driver takes away."""

from __future__ import annotations

import pytest

from retenta.llm import queries as registered
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert not differences(registered.queries()[name](spark, SF), connect(SF), registered.oracle_sql()[name])


def test_every_operator_has_a_query():
    names = registered.queries()
    assert {int(name[2:].split("_")[0]) for name in names} == set(range(1, 14)) and len(names) == 13
