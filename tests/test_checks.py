from __future__ import annotations

from decimal import Decimal

from fixtures import frames

from titlelake.operators import checks
from titlelake.schemas import TABLES


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, None)], "n int, s string")
    assert rows(checks.check_pk(df, ["n", "s"])) == [(1, "a", 2), (2, None, 2)]
    assert rows(checks.check_unique(df, "s")) == [("a", 2)]


def test_references(spark):
    child = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "c string")
    parent = spark.createDataFrame([("a",)], "p string")
    assert rows(checks.check_fk(child, "c", parent, "p")) == [("x", 2)]


def test_rules_share_one_pass(spark):
    df = spark.createDataFrame([("abc", None), ("a", 1), (None, None)], "s string, n int")
    found = checks.count_where(df, checks.not_null_rules(["s", "n"]) | checks.length_rules({"s": 2}))
    assert rows(found) == [("n is null", 2), ("s is null", 1), ("s longer than 2", 1)]
    assert rows(checks.check_not_null(df.limit(0), ["s"])) == [("s is null", 0)]


def test_rating_range(spark):
    values = [Decimal("99.9"), Decimal("99.94"), Decimal("99.95"), Decimal("-100"), None]
    df = spark.createDataFrame([(v,) for v in values], "average_rating decimal(6,2)")
    assert rows(checks.check_domain(df, checks.rating_rules())) == [("average_rating out of range", 2)]


def test_every_constraint_is_reported(spark):
    broken = frames(
        spark,
        title=[("tt1", "movie", None, None, False, None, None, None, None)] * 2
        + [("tt2", None, None, None, None, None, None, None, None), ("tt3456789012345", "x" * 21, None, None, True, None, None, None, None)],
        person=[("nm1", None, None, None)],
        genre=[(1, "Drama"), (2, "Drama"), (3, "x" * 51)],
        title_genre=[("tt1", 1), ("tt1", 1), ("tt1", 9), ("no", 1)],
        principal=[("tt1", 1, "nm1", "actor", None, None), ("tt1", 1, "nm9", "actor", None, None), ("no", 1, "nm9", None, None, None)],
        episode=[("tt1", "no", None, None), ("no", None, None, None)],
        rating=[("no", None, 1)],
        streaming_link=[("no", "p" * 51, None)],
    )
    found = {(r["table_name"], r["rule"]): r["violations"] for r in checks.violations(broken, list(TABLES)).collect()}
    assert {k: n for k, n in found.items() if n} == {
        ("title", "title_type is null"): 1,
        ("title", "is_adult is null"): 1,
        ("title", "tconst longer than 12"): 1,
        ("title", "title_type longer than 20"): 1,
        ("title", "tconst repeated"): 1,
        ("person", "primary_name is null"): 1,
        ("genre", "name longer than 50"): 1,
        ("genre", "name repeated"): 1,
        ("title_genre", "tconst, genre_id repeated"): 1,
        ("title_genre", "tconst not in title"): 1,
        ("title_genre", "genre_id not in genre"): 1,
        ("principal", "category is null"): 1,
        ("principal", "tconst, ordering repeated"): 1,
        ("principal", "tconst not in title"): 1,
        ("principal", "nconst not in person"): 1,
        ("episode", "parent_tconst is null"): 1,
        ("episode", "tconst not in title"): 1,
        ("episode", "parent_tconst not in title"): 1,
        ("rating", "average_rating is null"): 1,
        ("rating", "tconst not in title"): 1,
        ("streaming_link", "url is null"): 1,
        ("streaming_link", "platform longer than 50"): 1,
        ("streaming_link", "tconst not in title"): 1,
    }
    # Eight tables: 22 required columns, 12 lengths and one range, 9 keys, 8 references.
    assert len(found) == 22 + 12 + 1 + 9 + 8


def test_large_tables_are_dealt_out_before_their_keys_are_counted(spark, edges, no_broadcast):
    found = checks.violations(edges, ["title", "rating"])
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
