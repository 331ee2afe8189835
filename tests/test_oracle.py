"""Every registered query against DuckDB on the smallest test tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from compare import difference, duck

from titlelake.testing.oracle import ORACLE
from titlelake.testing.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")

# Queries whose plan differs when nothing is small enough to broadcast.
LARGE = [
    "load_principals", "load_title_genre", "cascade_delete", "home_top_rated", "title_documents",
    "person_documents", "prolific_actors", "genre_popularity", "payload_departments", "filmography",
]


def test_each_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)


def differences(spark, names) -> dict[str, str | None]:
    """All differences at once: the queries run side by side in one session."""

    def check(name):
        try:
            return difference(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLE[name])
        except Exception as error:
            return f"{type(error).__name__}: {error}"

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(names, pool.map(check, names), strict=True))


@pytest.fixture(scope="module")
def found(spark):
    return differences(spark, list(QUERIES))


@pytest.mark.parametrize("name", QUERIES)
def test_query(found, name):
    assert found[name] is None


def test_queries_without_broadcasts(spark, no_broadcast):
    found = differences(spark, LARGE)
    assert {name: said for name, said in found.items() if said} == {}


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.queries()) >= set(driver.oracle_sql())
