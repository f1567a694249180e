"""Queries of this package against their SQL over the smallest tables; those without SQL run."""

import pytest

import test_queries as core
from lumaframe.llm.queries import QUERIES

pytestmark = core.pytestmark
duck = core.duck


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    core.compare(spark, duck, name)
