"""Queries against their SQL on tables with zeros, ties and copies."""

import os
import shutil

import duckdb
import pytest

from barloom.plans import check, registry

registry.load_all()


def changed(small, folder, **tables):
    """The smallest tables with some of them replaced by SQL over ``t``, the table itself."""
    folder = str(folder)
    for name in os.listdir(small):
        if name.endswith(".parquet") and name[:-8] not in tables:
            shutil.copy(f"{small}/{name}", folder)
    for name, sql in tables.items():
        duckdb.execute(f"COPY (WITH t AS (FROM '{small}/{name}.parquet') {sql}) TO '{folder}/{name}.parquet'")
    return folder


def same(spark, folder, name):
    status, _, rows, note = check.compare(spark, check.connect(folder), folder, name)
    assert status == "ok" and rows, note


@pytest.fixture(scope="module")
def zeros(small, tmp_path_factory):
    return changed(small, tmp_path_factory.mktemp("zeros"), events="SELECT * REPLACE (CASE WHEN event_id % 7 = 3 AND user_id % 2 = 0 THEN 0 ELSE value END AS value) FROM t")


def test_size_with_prices_of_zero(spark, zeros):
    same(spark, zeros, "E21_vol_target_size")


def test_stop_with_prices_of_zero(spark, zeros):
    same(spark, zeros, "E22_adaptive_stop")


@pytest.fixture(scope="module")
def copies(small, tmp_path_factory):
    """Each user forty times, rows in any order: equal statistics whose sums round differently."""
    return changed(
        small, tmp_path_factory.mktemp("copies"),
        events="SELECT t.* REPLACE (event_id + 1000 * i AS event_id, user_id + 15 * i AS user_id) FROM t, range(40) x(i) ORDER BY hash(event_id, i)",
    )


def test_best_and_worst_among_copies(spark, copies):
    same(spark, copies, "G04_population_extremes")


def test_best_and_worst_without_spread(spark, small, tmp_path):
    """Rules whose returns are all alike, and rules whose returns differ in the last cent alone, many times in any order."""
    folder = changed(
        small, tmp_path,
        events="SELECT t.* REPLACE (event_id * 50 + i AS event_id, event_id // 7 AS user_id, 200 + event_id // 7 * 0.37 + CASE WHEN event_id // 7 % 3 > 0 THEN (i * 3 + event_id) % 4 / 100 ELSE 0 END AS value) FROM t, range(50) x(i) ORDER BY hash(event_id, i)",
    )
    same(spark, folder, "G04_population_extremes")


@pytest.fixture(scope="module")
def halves(small, tmp_path_factory):
    """Means of six prices in cents: the triple of many lies half-way between two thousandths."""
    return changed(
        small, tmp_path_factory.mktemp("halves"),
        events="SELECT t.* REPLACE ((event_id * 20 + i) // 6 AS user_id, 'click' AS event_type, (event_id * 20 + i) * 7919 % 10007 / 100.0::DOUBLE AS value) FROM t, range(20) x(i)",
    )


def test_false_discovery_of_half_thousandths(spark, halves):
    same(spark, halves, "G15_bh_fdr")


def test_step_up_of_half_thousandths(spark, halves):
    same(spark, halves, "G15_bh_step_up")


def test_lake_keeps_one_bar_of_a_time(spark, small, tmp_path):
    folder = changed(small, tmp_path, events="SELECT t.* REPLACE (event_id + 1000 * i AS event_id, value + i % 2 AS value) FROM t, range(3) x(i)")
    same(spark, folder, "K01_stream_bars")
