"""Registered queries against their SQL in DuckDB, on the smallest tables.

All but most of the streaming ones run by default; ``TEST_ALL_QUERIES=1`` (or ``python tests/oracle.py``) runs those too.
"""

import os

import pytest

import __spark_entry__ as entry
from tickbars.queries import all_queries, all_sql, stream_queries
from oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
# Streams are drained by tests of their own; of their queries a few run here.
STREAMS = ("stream_bars_exact", "keyed_bars_clock", "silent_symbols", "smoothed_delay", "clock_measurements", "latest_sync", "clock_ticks")
NAMES = list(all_queries())
if not os.environ.get("TEST_ALL_QUERIES"):
    NAMES = [n for n in NAMES if n not in stream_queries.QUERIES or n in STREAMS]
# These have no rows on the smallest tables.
MAY_BE_EMPTY = {"new_symbols", "log_search", "trace_by_id"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(all_sql()) == set(all_queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    found = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert found is None or (found == "both empty" and name in MAY_BE_EMPTY), found


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
