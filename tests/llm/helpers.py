"""Shared by these tests."""

from barloom.llm.queries import ORACLES, QUERIES
from barloom.plans import check

SMALL = "/root/testdata/sf0.001"


def matches_sql(spark, name, folder=SMALL):
    got = check.normal(QUERIES[name](spark, folder).toPandas())
    want = check.normal(check.connect(folder).execute(ORACLES[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    assert not (got != want).any(axis=None)
