from __future__ import annotations

from decimal import Decimal
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from titlelake.functions import media, numbers, roles, text


@pytest.fixture
def over(spark):
    """Values of an expression over a list of texts."""

    def run(expression, values, kind="string"):
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}").coalesce(1)
        return [r[0] for r in df.select(expression(F.col("v"))).collect()]

    return run


def test_clean_and_scrub(over):
    assert over(text.clean, ["\\N", "", "x", None, "\\n"]) == [None, None, "x", None, "\\n"]
    assert over(text.scrub, ["a\tb\nc", None]) == ["a b c", None]
    assert over(text.norm, ["  AbC ", None]) == ["abc", None]


def test_url_component(over):
    names = ["Se7en", "a b&c", "!*'()~-_.", "é/ü?", "100%", "%21", "日本", ""]
    assert over(text.url_component, names) == [quote(n, safe="!*'()~-_.") for n in names]


def test_years(over):
    assert over(text.year_of, ["1999-01-02", "2000", "199", "", None, "abcd"]) == [1999, 2000, None, None, None, None]


def test_first_of_json(over):
    assert over(text.first_of_json, ['["A","B"]', "[]", None, "x", '["é"]']) == ["A", None, None, None, "é"]


def test_short_text(over):
    assert over(text.shorten, ["x" * 200, None, "ab"]) == ["x" * 160, "", "ab"]


def test_local_ids(over):
    assert over(lambda v: text.is_local(v, "tt"), ["tt1", "nm1", "12", None]) == [True, False, False, False]


def test_matching(over):
    values = ["Straße", "STRASSE", "50% off", "a_b", "axb", None]
    assert over(lambda v: text.contains_ci(v, "a_b"), values) == [False, False, False, True, True, None]
    assert over(lambda v: text.contains_ci(v, "a_b", literal=True), values) == [False, False, False, True, False, None]
    assert over(lambda v: text.prefix_ci(v, "50%", literal=True), values)[2] is True
    assert over(lambda v: text.contains_ci(v, "ÉT"), ["été", "ete"]) == [True, False]


def test_display(over):
    values = [Decimal("9.0"), Decimal("10.0"), None]
    assert over(numbers.rating_text, values, "decimal(3,1)") == ["9.0", "10.0", None]
    assert over(numbers.votes_text, [1234567, 12, None], "int") == ["1,234,567", "12", None]


def test_ranks(over):
    values = ["director", "editor", "stunts", None]
    assert over(lambda v: roles.role_rank(v, roles.CREDIT_ROLES), values) == [1, 8, 9, 9]
    assert over(lambda v: roles.role_rank(v, roles.FILMOGRAPHY_ROLES), values) == [1, 6, 6, 6]


def test_images(over):
    values = ["/p.jpg", "http://x/y.jpg", "", None]
    assert over(media.image_url, values) == [f"{media.IMAGE_BASE}/w500/p.jpg", "http://x/y.jpg", None, None]
    assert over(lambda v: media.image_url(v, "w92"), values)[0] == f"{media.IMAGE_BASE}/w92/p.jpg"


def test_platforms(over):
    assert over(lambda v: media.platform_field(v, 1), ["NETFLIX", "disney+", "radio", None]) == [
        "#E50914", "#113CCF", "#666", "#666",
    ]


@pytest.mark.parametrize(
    "name, link",
    [
        ("Netflix", "https://www.netflix.com/search?q=A%20%26%20B"),
        ("Amazon Prime Video with Ads", "https://www.amazon.com/s?k=A%20%26%20B&i=instant-video"),
        # "apple tv plus" contains "apple tv", and stands before it
        ("Apple TV", "https://tv.apple.com/search?term=A%20%26%20B"),
        # "hbo max" contains "max", which stands before it
        ("HBO Max", "https://play.max.com/search?q=A%20%26%20B"),
        # an empty name is contained in every rule
        ("", "https://www.netflix.com/search?q=A%20%26%20B"),
        (None, "https://www.netflix.com/search?q=A%20%26%20B"),
        (" STARZ ", "https://www.starz.com/search?q=A%20%26%20B"),
        ("Corner {t} Shop", "https://www.google.com/search?q=watch+A%20%26%20B+on+Corner%20%7Bt%7D%20Shop"),
    ],
)
def test_provider_links(over, name, link):
    assert over(lambda v: media.provider_url(v, F.lit("A & B")), [name]) == [link]


def test_titles_with_placeholders_stay_literal(over):
    assert over(lambda v: media.provider_url(F.lit("Shop"), v), ["{n}{t}"]) == [
        "https://www.google.com/search?q=watch+%7Bn%7D%7Bt%7D+on+Shop"
    ]
