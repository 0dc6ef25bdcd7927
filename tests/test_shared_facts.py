"""Queries that read schema and statistics of one table shuffle its distinct values once."""

import pytest

from catalogue import queries
from colprism.operators import facts


@pytest.mark.parametrize("name", ["search_columns"])
def test_distinct_values_are_counted_once(spark, monkeypatch, name):
    calls, counted = [], facts.distinct_counts

    def watched(*args, **more):
        calls.append(args)
        return counted(*args, **more)
    monkeypatch.setattr(facts, "distinct_counts", watched)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1
