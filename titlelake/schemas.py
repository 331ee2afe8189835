"""Schemas, keys and references of the eight catalogue tables and of the raw dumps."""

from __future__ import annotations

# The typed tables. `TABLES[name]` is a Spark DDL string.
TABLES = {
    "title": (
        "tconst string, title_type string, primary_title string, original_title string, "
        "is_adult boolean, start_year smallint, end_year smallint, runtime_minutes int, poster_url string"
    ),
    "person": "nconst string, primary_name string, birth_year smallint, death_year smallint",
    "episode": "tconst string, parent_tconst string, season_number smallint, episode_number smallint",
    "principal": (
        "tconst string, ordering smallint, nconst string, category string, job string, characters string"
    ),
    "genre": "genre_id int, name string",
    "title_genre": "tconst string, genre_id int",
    "rating": "tconst string, average_rating decimal(3,1), num_votes int",
    "streaming_link": "tconst string, platform string, url string",
}

PRIMARY_KEYS = {
    "title": ["tconst"],
    "person": ["nconst"],
    "episode": ["tconst"],
    "principal": ["tconst", "ordering"],
    "genre": ["genre_id"],
    "title_genre": ["tconst", "genre_id"],
    "rating": ["tconst"],
    "streaming_link": ["tconst", "platform"],
}

UNIQUE = {"genre": ["name"]}

# (child table, child column, parent table, parent key)
REFERENCES = [
    ("episode", "tconst", "title", "tconst"),
    ("episode", "parent_tconst", "title", "tconst"),
    ("principal", "tconst", "title", "tconst"),
    ("principal", "nconst", "person", "nconst"),
    ("title_genre", "tconst", "title", "tconst"),
    ("title_genre", "genre_id", "genre", "genre_id"),
    ("rating", "tconst", "title", "tconst"),
    ("streaming_link", "tconst", "title", "tconst"),
]

REQUIRED = {
    "title": ["tconst", "title_type", "is_adult"],
    "person": ["nconst", "primary_name"],
    "episode": ["tconst", "parent_tconst"],
    "principal": ["tconst", "ordering", "nconst", "category"],
    "genre": ["genre_id", "name"],
    "title_genre": ["tconst", "genre_id"],
    "rating": ["tconst", "average_rating", "num_votes"],
    "streaming_link": ["tconst", "platform", "url"],
}

# Longest text each column may hold.
TEXT_LIMITS = {
    "title": {"tconst": 12, "title_type": 20},
    "person": {"nconst": 12},
    "episode": {"tconst": 12, "parent_tconst": 12},
    "principal": {"tconst": 12, "nconst": 12, "category": 30},
    "genre": {"name": 50},
    "title_genre": {"tconst": 12},
    "rating": {"tconst": 12},
    "streaming_link": {"tconst": 12, "platform": 50},
}

# Header names of the raw tab-separated dumps, in file order.
DUMPS = {
    "title.basics": [
        "tconst", "titleType", "primaryTitle", "originalTitle", "isAdult",
        "startYear", "endYear", "runtimeMinutes", "genres",
    ],
    "title.ratings": ["tconst", "averageRating", "numVotes"],
    "name.basics": [
        "nconst", "primaryName", "birthYear", "deathYear", "primaryProfession", "knownForTitles",
    ],
    "title.principals": ["tconst", "ordering", "nconst", "category", "job", "characters"],
    "title.episode": ["tconst", "parentTconst", "seasonNumber", "episodeNumber"],
}
