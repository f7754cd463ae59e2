"""Every registered query against its SQL on the smallest tables."""

import pytest

from barloom.plans import check, registry

registry.load_all()


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_sql(spark, con, small, name):
    status, _, rows, note = check.compare(spark, con, small, name)
    assert status in ("ok", "rows"), f"{status}: {note}"
    assert rows > 0 or name in ("G06_gate_diagnostic",)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
