"""Saves: tables at once, and tables that come in ranges."""

from __future__ import annotations

import threading

import pytest

from titlelake.catalog import Catalog
from titlelake.sources import testbed
from titlelake.sources.shared import JOBS, together
from titlelake.sources.tables import load_catalog, save_catalog, versions

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date, l_returnflag string, l_linestatus string"


@pytest.fixture
def tables(spark, tmp_path):
    """Line items with repeats and null keys, and parts with a repeated key."""
    flags = "AF RO NF".split()
    lines = [(k % 40 if k % 7 else None, k % 3 if k % 11 else None, k % 9, k % 5, float(k % 4), None, flags[k % 3][0], flags[k % 3][1]) for k in range(300)]
    spark.createDataFrame(lines + lines[:20], LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = [(k, f"Brand#{k % 3}") for k in range(8)] + [(1, "Brand#2"), (None, "Brand#0"), (3, None)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["principal", "title_genre"])
def test_a_table_in_ranges_has_the_rows_of_the_table_and_moves_once(spark, tables, name, no_broadcast):
    cat = testbed.catalogue(spark, tables)
    ranged = cat.ranged(name, cat[name].columns)
    assert ranged.columns == cat[name].columns
    assert sorted(map(str, ranged.collect())) == sorted(map(str, cat[name].collect()))
    text = ranged._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(tconst" in text
    # The ranges are the last to move the rows: a sort or a sum follows, but no other exchange is above them.
    assert text.index("rangepartitioning(") < (text.index("hashpartitioning(") if "hashpartitioning(" in text else len(text))


def test_a_replaced_table_is_the_one_that_is_saved(spark, tables, tmp_path):
    cat = testbed.catalogue(spark, tables)
    few = cat.replace(principal=cat.principal.filter("tconst = 'tt0000003'"))
    save_catalog(few, f"{tmp_path}/store", ["principal", "title_genre"])
    saved = load_catalog(spark, f"{tmp_path}/store")
    assert sorted(map(str, saved.principal.collect())) == sorted(map(str, few.principal.collect()))
    assert saved.title_genre.count() == cat.title_genre.count()


def test_jobs_run_at_once_and_an_error_is_raised(spark):
    meet = threading.Barrier(JOBS, timeout=30)
    assert together(spark, [lambda i=i: (meet.wait(), i)[1] for i in range(JOBS)]) == list(range(JOBS))
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1, lambda: 1 // 0])


def test_a_save_of_several_tables_of_which_one_fails_changes_nothing(spark, tables, tmp_path):
    cat, path = testbed.catalogue(spark, tables), f"{tmp_path}/store"
    save_catalog(cat, path, ["principal"])

    def opened(name):
        if name == "title_genre":
            raise OSError("gone")
        return cat[name]

    with pytest.raises(OSError):
        save_catalog(Catalog(opened), path, ["principal", "title_genre"])
    assert versions(spark, path) == [1]
