"""Small catalogues: one of invented titles, one of rows at the edges."""

from __future__ import annotations

from decimal import Decimal

from titlelake import Catalog
from titlelake.schemas import TABLES

# A catalogue made by rule. Film k of 1 to 9 is a television film if four divides k.
FILMS = ["Tin Kettle", "Inkwell", "Orchard", "Winter Rye", "Salt", "Inlet", "Mandolin", "Harvest", "Plum"]
SERIES, PARTS = "tt0007900", {"tt0007901": (1, 1), "tt0007902": (2, 1), "tt0007903": (2, 2)}
PEOPLE = {"nm0000801": "Ruby Kemp", "nm0000802": "Sol Aster", "nm0000803": "Inez Holt", "nm0000804": "Dana Frisk", "nm0000805": "Olu Marsh"}


def film(k: int) -> str:
    return f"tt{7000 + 10 * k:07d}"


def film_genres(k: int) -> list[str]:
    """By the divisors of k, the last films are of the war, and what is left is noir."""
    found = [name for name, holds in (("Musical", k % 2 == 0), ("Western", k % 3 == 0), ("War", k > 6)) if holds]
    return found or ["Noir"]


def frames(spark, **tables) -> Catalog:
    """A catalogue of the given rows; tables not given are empty."""
    return Catalog.of({name: spark.createDataFrame(tables.get(name, []), ddl) for name, ddl in TABLES.items()})


def seed_catalogue(spark) -> Catalog:
    """Nine films, nine years apart, and a series of three parts in two seasons."""
    title, rating, links = [], [], []
    for k, name in enumerate(FILMS, 1):
        kind = "tvMovie" if k % 4 == 0 else "movie"
        title.append((film(k), kind, name, name, False, 1921 + 9 * k, None, 60 + k, None))
        rating.append((film(k), Decimal(50 + 7 * k % 30) / 10, 20_000 + 15_000 * (5 * k % 9)))
        links += [(film(k), genre) for genre in film_genres(k)]
    title.append((SERIES, "tvMiniSeries", "Lantern Row", "Lantern Row", False, 1987, 1988, 30, None))
    rating.append((SERIES, Decimal("7.4"), 50_000))
    links.append((SERIES, "Noir"))
    for part, (season, number) in PARTS.items():
        title.append((part, "tvEpisode", f"Part {season}.{number}", "Part", False, 1986 + season, None, 30, None))
        rating.append((part, Decimal("8.9"), 300))
    ids = {genre: number for number, genre in enumerate(sorted({genre for _, genre in links}), 1)}
    cast = ["actor", "composer", "actress", "director"]
    credits = [(film(4), place, f"nm000080{place}", role, None, None) for place, role in enumerate(cast, 1)]
    credits += [(film(k), 1, "nm0000804", "director", None, None) for k in (2, 8)]
    credits += [(film(3), 1, "nm0000805", "director", None, None)]
    credits += [(key, 1, "nm0000803", "actress", None, '["Keeper"]') for key in (SERIES, "tt0007903")]
    return frames(
        spark,
        title=title,
        rating=rating,
        genre=[(number, genre) for genre, number in ids.items()],
        title_genre=[(key, ids[genre]) for key, genre in links],
        person=[(key, name, None, None) for key, name in PEOPLE.items()],
        principal=credits,
        episode=[(part, SERIES, season, number) for part, (season, number) in PARTS.items()],
    )


def edge_catalogue(spark) -> Catalog:
    """Unrated, undated, early, adult and genreless titles; odd episodes; namesakes."""
    return frames(
        spark,
        title=[
            ("tt1", "movie", "Red 100% Ring", "Red", False, 1999, None, 90, "/one.jpg"),
            ("tt2", "movie", "red_ring", "red", False, None, None, None, ""),
            ("tt3", "movie", "Adult Ring", "Adult", True, 1985, None, 80, None),
            ("tt4", "tvSeries", "Series", "Series", False, 1880, 1890, 30, None),
            ("tt5", "tvEpisode", "Ring Episode", "E", False, 2001, None, 30, None),
            ("tt6", "tvEpisode", "Later", "E", False, 2002, None, None, None),
            ("tt7", "tvEpisode", "Unplaced", "E", False, 2003, None, None, None),
            ("tt8", "tvEpisode", "Unnumbered", "E", False, 2003, None, None, None),
            ("tt9", "videoGame", "Ring Game", "G", False, 2005, None, None, None),
        ],
        rating=[
            ("tt1", Decimal("8.0"), 30000),
            ("tt3", Decimal("9.9"), 40000),
            ("tt4", Decimal("7.5"), 26000),
            ("tt5", Decimal("9.9"), 90000),
            ("tt6", Decimal("5.0"), 10),
            ("tt9", Decimal("9.9"), 99999),
        ],
        genre=[(1, "Crime"), (2, "Drama")],
        title_genre=[("tt1", 2), ("tt1", 1), ("tt4", 2)],
        person=[
            ("nm1", "Ana", 1950, None),
            ("nm2", "Ana", 1960, 2000),
            ("nm3", "Ben", None, None),
            ("nm4", "No Credit", None, None),
        ],
        principal=[
            ("tt1", 1, "nm1", "actor", None, '["Lead","Twin"]'),
            ("tt1", 2, "nm1", "actress", None, "[]"),
            ("tt1", 3, "nm2", "actor", None, "not json"),
            ("tt1", 4, "nm3", "writer", "story", None),
            ("tt1", 5, "nm3", "director", None, None),
            ("tt1", 6, "nm3", "stunts", None, None),
            ("tt1", 7, "nm3", "editor", None, None),
            ("tt2", 1, "nm1", "actor", None, None),
            ("tt4", 1, "nm1", "actor", None, None),
            ("tt4", 2, "nm3", "producer", None, None),
        ],
        episode=[
            ("tt5", "tt4", 0, 2),
            ("tt6", "tt4", 1, 1),
            ("tt7", "tt4", None, None),
            ("tt8", "tt4", 0, None),
        ],
        streaming_link=[("tt1", "Netflix", "https://n/1"), ("tt1", "corner", "https://c/1")],
    )
