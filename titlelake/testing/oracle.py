"""DuckDB SQL for every query of :mod:`titlelake.testing.queries`.

``TABLES`` restates the adapter of :mod:`titlelake.sources.testbed`; a statement takes
the tables it names as common table expressions.
"""

from __future__ import annotations

from titlelake.functions.media import (
    IMAGE_BASE,
    OTHER_PLATFORM,
    OTHER_PROVIDER,
    PLATFORMS,
    PROVIDER_RULES,
)
from titlelake.functions.roles import CREDIT_ROLES, FILMOGRAPHY_ROLES
from titlelake.schemas import PRIMARY_KEYS, REFERENCES, REQUIRED, TEXT_LIMITS, UNIQUE
from titlelake.schemas import TABLES as NAMES
from titlelake.testing.queries import (
    ACTOR_MIN_TITLES,
    AFTER,
    DIRECTOR_MIN,
    DISCOVER,
    FACETS,
    GENRES_GONE,
    GENRE_MIN_LINKS,
    INDEXED,
    PEOPLE_SEARCH,
    PROVIDER_NAMES,
    SEARCH,
)


def ident(prefix: str, column: str) -> str:
    digits = f"CAST({column} AS VARCHAR)"
    return f"'{prefix}' || lpad({digits}, CAST(greatest(7, length({digits})) AS INT), '0')"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


CATEGORY = """CASE l_returnflag || l_linestatus
    WHEN 'AF' THEN 'director' WHEN 'AO' THEN 'writer' WHEN 'RF' THEN 'actor'
    WHEN 'RO' THEN 'actress' WHEN 'NF' THEN 'producer' WHEN 'NO' THEN 'composer' END"""

TABLES = {
    "title": f"""
SELECT {ident('tt', 'o_orderkey')} AS tconst,
  list_value('movie', 'tvSeries', 'tvMovie', 'tvEpisode', 'videoGame')[CAST(o_orderpriority[1] AS INT)] AS title_type,
  p_name || ' ' || o_orderkey AS primary_title,
  p_name AS original_title,
  o_orderkey % 50 = 0 AS is_adult,
  CASE WHEN o_orderkey % 17 <> 0 THEN year(o_orderdate) - 10 * (o_orderkey % 12) END AS start_year,
  CASE WHEN o_orderkey % 17 <> 0 AND o_orderpriority LIKE '2%'
       THEN year(o_orderdate) - 10 * (o_orderkey % 12) + 3 END AS end_year,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 240 + 1 END AS runtime_minutes,
  CASE WHEN o_orderkey % 3 = 0 THEN '/p' || o_orderkey || '.jpg' END AS poster_url
FROM (SELECT *, o_orderkey % (SELECT count(*) FROM part) AS p_partkey FROM orders) JOIN part USING (p_partkey)""",
    "person": f"""
SELECT {ident('nm', 's_suppkey')} AS nconst, s_name AS primary_name,
  1900 + s_suppkey % 100 AS birth_year,
  CASE WHEN s_suppkey % 4 = 0 THEN 1960 + s_suppkey % 100 END AS death_year
FROM supplier""",
    "solvent": f"SELECT {ident('nm', 's_suppkey')} AS nconst FROM supplier WHERE s_acctbal >= 0",
    "credit": f"""
SELECT {ident('tt', 'l_orderkey')} AS tconst, CAST(l_linenumber AS BIGINT) AS ordering,
  {ident('nm', 'l_suppkey')} AS nconst, {CATEGORY} AS category,
  CASE WHEN l_linenumber % 2 = 0 THEN 'job ' || l_partkey END AS job,
  CASE WHEN {CATEGORY} IN ('actor', 'actress') THEN '["Role ' || l_partkey || '"]' END AS characters,
  l_partkey, l_suppkey, l_extendedprice, l_shipdate
FROM lineitem""",
    "principal": """
SELECT tconst, ordering, nconst, category, job, characters FROM credit
QUALIFY row_number() OVER (PARTITION BY tconst, ordering
                           ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1""",
    "genre": "SELECT row_number() OVER (ORDER BY name) AS genre_id, name FROM (SELECT DISTINCT p_brand AS name FROM part)",
    "title_genre": f"""
SELECT DISTINCT {ident('tt', 'l_orderkey')} AS tconst, genre_id
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN genre ON name = p_brand""",
    "rating": f"""
SELECT {ident('tt', 'o_orderkey')} AS tconst,
  CAST(((o_orderkey * 37) % 91 + 10) * 0.1 AS DECIMAL(3,1)) AS average_rating,
  CAST(floor(o_totalprice) AS BIGINT) AS num_votes
FROM orders WHERE o_orderstatus <> 'P'""",
    "episode": f"""
SELECT {ident('tt', 'o.o_orderkey')} AS tconst, {ident('tt', 's.parent')} AS parent_tconst,
  CASE WHEN month(o_orderdate) <> 12 THEN year(o_orderdate) - 1994 END AS season_number,
  o.o_orderkey % 24 + 1 AS episode_number
FROM orders o JOIN (SELECT o_custkey, min(o_orderkey) AS parent FROM orders
                    WHERE o_orderpriority LIKE '2%' GROUP BY o_custkey) s USING (o_custkey)
WHERE o_orderpriority LIKE '4%'""",
    "streaming_link": f"""
SELECT {ident('tt', 'user_id')} AS tconst, event_type AS platform,
  'https://watch.example/' || event_id AS url
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "link_change": f"""
SELECT {ident('tt', 'user_id')} AS tconst,
  CASE WHEN NOT (event_type = 'error' AND value < 2) THEN event_type END AS platform,
  CASE WHEN value < 1 THEN '' ELSE 'https://watch.example/' || event_id END AS url, ts, event_id
FROM events""",
    "old_link": f"""
SELECT {ident('tt', 'user_id')} AS tconst, platform, 'https://old.example/' || {ident('tt', 'user_id')} AS url
FROM (SELECT DISTINCT user_id FROM events), (VALUES ('view'), ('archive')) AS p(platform)""",
    "genres": """
SELECT tconst, string_agg(name, ', ' ORDER BY name) AS genres, list(name ORDER BY name) AS names
FROM title_genre JOIN genre USING (genre_id) GROUP BY tconst""",
    "named": "SELECT pr.*, p.primary_name AS name FROM principal pr JOIN person p USING (nconst)",
    "film": """
SELECT pr.nconst, pr.category, t.tconst, t.primary_title, t.title_type, t.start_year,
  CAST(r.average_rating AS DOUBLE) AS average_rating, r.num_votes, pr.characters, pr.job, pr.ordering
FROM principal pr JOIN title t USING (tconst) LEFT JOIN rating r USING (tconst)""",
    "card": """
SELECT t.tconst AS id, primary_title AS title, start_year AS year, runtime_minutes AS runtime,
  title_type AS type, poster_url AS poster, CAST(average_rating AS DOUBLE) AS rating, num_votes AS votes,
  coalesce(g.genres, '') AS genres, is_adult
FROM title t LEFT JOIN rating r USING (tconst) LEFT JOIN genres g USING (tconst)""",
    "role": "SELECT *, CASE WHEN title_type = 'tvSeries' THEN 'tv' ELSE 'movie' END AS kind FROM film",
}

NEEDS = {
    "principal": ["credit"],
    "title_genre": ["genre"],
    "genres": ["genre", "title_genre"],
    "named": ["credit", "principal", "person"],
    "film": ["credit", "principal", "title", "rating"],
    "card": ["title", "rating", "genre", "title_genre", "genres"],
    "role": ["credit", "principal", "title", "rating", "film"],
}


def sql(tables: str, body: str) -> str:
    """A statement over the given adapter tables."""
    wanted = set(tables.split())
    for name in tables.split():
        wanted |= set(NEEDS.get(name, []))
    parts = [f"{name} AS ({TABLES[name].strip()})" for name in TABLES if name in wanted]
    return f"WITH {', '.join(parts)}\n{body.strip()}" if parts else body.strip()


def rank(column: str, roles: list[str]) -> str:
    cases = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(roles, 1))
    return f"CAST(CASE {column} {cases} ELSE {len(roles) + 1} END AS BIGINT)"


# Mean at two decimals, half up, from whole numbers.
def mean(tenths: str, rows: str) -> str:
    return f"(CAST({tenths} AS BIGINT) * 20 + {rows}) // ({rows} * 2) / 100.0"


TENTHS = "CAST(average_rating * 10 AS BIGINT)"
HOME = "id, title, year, runtime, type, rating, votes, genres"
CARD = "id, title, year, runtime, type, poster, rating, votes"
STANDALONE = "type NOT IN ('tvEpisode', 'videoGame') AND votes IS NOT NULL"

FOUND = "title ILIKE '%{q}%' AND type <> 'tvEpisode' AND NOT is_adult"


def search(where: str, order: str, page: int = 1) -> str:
    """A page of title search; `has_more` looks past its end."""
    return sql(
        "card",
        f"""
SELECT {CARD}, 'title' AS result_type, row_number() OVER (ORDER BY {order}) AS place,
  (SELECT count(*) FROM card WHERE {where}) > {20 * page} AS has_more,
  {page} + CAST((SELECT count(*) FROM card WHERE {where}) > {20 * page} AS BIGINT) AS total_pages
FROM card WHERE {where} ORDER BY {order} LIMIT 20 OFFSET {20 * (page - 1)}""",
    )


def encoded(column: str) -> str:
    """URL component encoding; DuckDB escapes six characters more than wanted."""
    text = f"url_encode({column})"
    for code, plain in [("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")]:
        text = f"replace({text}, '{code}', '{plain}')"
    return text


def _provider_case() -> str:
    name = "lower(trim(provider))"
    cases = " ".join(
        f"WHEN contains({name}, '{p}') OR contains('{p}', {name}) THEN '{u}'" for p, u in PROVIDER_RULES
    )
    return f"CASE {cases} ELSE '{OTHER_PROVIDER}' END"


def _platform(field: int) -> str:
    cases = " ".join(f"WHEN '{p}' THEN '{info[field]}'" for p, info in PLATFORMS.items())
    return f"CASE lower(platform) {cases} ELSE '{OTHER_PLATFORM[field]}' END"


def _not_null(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c} is null' AS rule, count(*) AS violations FROM {table} WHERE {c} IS NULL" for c in columns
    )


def _violations(tables: str, source: dict[str, str]) -> str:
    """All constraints; ``source`` holds what stands for a table where that isn't the table itself."""
    parts = []
    for name in NAMES:
        own = source.get(name, name)
        rules = [(f"{c} is null", f"{c} IS NULL") for c in REQUIRED[name]]
        rules += [(f"{c} longer than {n}", f"length({c}) > {n}") for c, n in TEXT_LIMITS[name].items()]
        if name == "rating":
            rules.append(("average_rating out of range", "abs(average_rating) >= 100"))
        found = [(rule, f"SELECT count(*) AS violations, count(*) AS rows FROM {own} WHERE {bad}") for rule, bad in rules]
        for keys in [PRIMARY_KEYS[name]] + [[c] for c in UNIQUE.get(name, [])]:
            key = ", ".join(keys)
            repeated = f"SELECT count(*) AS n FROM {own} GROUP BY {key} HAVING count(*) > 1"
            found.append((f"{key} repeated", f"SELECT count(*) AS violations, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM ({repeated})"))
        for child, column, parent, key in REFERENCES:
            if child == name:
                orphan = f"{column} NOT IN (SELECT {key} FROM {source.get(parent, parent)})"
                found.append((f"{column} not in {parent}", f"SELECT count(DISTINCT {column}) AS violations, count(*) AS rows FROM {own} WHERE {orphan}"))
        parts += [f"SELECT '{name}' AS table_name, '{rule}' AS rule, violations, rows FROM ({q})" for rule, q in found]
    return sql(tables, "\nUNION ALL\n".join(parts))


# What the changes of the merge queries leave.
MERGED = {
    "rating": """(SELECT tconst, CAST(CASE WHEN num_votes % 2 = 0 THEN 5 ELSE average_rating END AS DECIMAL(3,1)) AS average_rating,
      CASE WHEN num_votes % 2 = 0 THEN num_votes - 1 ELSE num_votes END AS num_votes
    FROM rating WHERE num_votes % 2 = 0 OR num_votes % 11 <> 0)""",
    "episode": """(SELECT tconst, CASE WHEN episode_number % 6 = 0 THEN 'tt0000001' ELSE parent_tconst END AS parent_tconst,
      season_number, episode_number FROM episode WHERE episode_number % 6 = 0 OR episode_number % 5 <> 0)""",
    "person": """(SELECT nconst, CASE WHEN nconst LIKE '%0' THEN 'Renamed' ELSE primary_name END AS primary_name, birth_year, death_year
    FROM person)""",
    "title": "(SELECT * FROM title WHERE title_type <> 'videoGame')",
}
EVERYONE = "(SELECT * FROM person SEMI JOIN solvent USING (nconst))"

def _trends() -> str:
    """The trend tables of the merged catalogue in one list."""
    title, rating, person = MERGED["title"], MERGED["rating"], MERGED["person"]
    decade, null = "(start_year // 10) * 10", "CAST(NULL AS {})"
    no_name, no_decade, no_mean = null.format("VARCHAR"), null.format("BIGINT"), null.format("DOUBLE")
    chart = "title_type IN ('movie', 'tvSeries', 'tvMovie')"

    def row(kind: str, name: str, dec: str, n: str, average: str) -> str:
        return f"SELECT '{kind}' AS kind, {name} AS name, {dec} AS decade, {n} AS n, {average} AS mean"

    every = mean(f"sum({TENTHS})", "count(*)")
    rated = mean(f"sum({TENTHS})", "count(average_rating)")
    return sql(
        "title rating principal person genre title_genre",
        f"""
, r AS {rating}, t AS {title}, p AS {person}
{row('rated', no_name, decade, 'count(*)', every)} FROM t JOIN r USING (tconst) WHERE start_year >= 1890 AND {chart} GROUP BY {decade}
UNION ALL {row('dated', no_name, decade, 'count(*)', no_mean)} FROM t WHERE start_year IS NOT NULL GROUP BY {decade}
UNION ALL ({row('director', 'primary_name', no_decade, 'count(*)', every)}
  FROM principal JOIN p USING (nconst) JOIN r USING (tconst) WHERE category = 'director'
  GROUP BY primary_name HAVING count(*) >= {DIRECTOR_MIN} ORDER BY mean DESC, name LIMIT 20)
UNION ALL {row('genre', 'name', decade, 'count(*)', no_mean)}
  FROM t JOIN title_genre USING (tconst) JOIN genre USING (genre_id) WHERE start_year >= 1950 AND {chart}
  AND name IN (SELECT name FROM title_genre JOIN genre USING (genre_id) GROUP BY name HAVING count(*) >= {GENRE_MIN_LINKS})
  GROUP BY name, {decade}
UNION ALL ({row('actor', 'primary_name', no_decade, 'count(DISTINCT tconst)', rated)}
  FROM principal JOIN p USING (nconst) LEFT JOIN r USING (tconst) WHERE category IN ('actor', 'actress')
  GROUP BY primary_name HAVING count(DISTINCT tconst) >= {ACTOR_MIN_TITLES} ORDER BY n DESC, name LIMIT 20)""",
    )


def _indexed() -> str:
    """A page of each search of the index query."""
    pages = []
    for query in INDEXED:
        # A backslash before an ordinary character means that character.
        pattern = query.strip().replace("\\r", "r")
        where = f"title ILIKE '%{pattern}%' AND type <> 'tvEpisode'"
        order = f"CASE WHEN title ILIKE '{pattern}%' THEN 0 ELSE 1 END, votes DESC NULLS LAST, id"
        pages.append(f"""
(SELECT '{query}' AS query, row_number() OVER (ORDER BY {order}) AS place, id, title, year, rating, votes,
  (SELECT count(*) FROM card WHERE {where}) > 20 AS has_more FROM card WHERE {where} ORDER BY {order} LIMIT 20)""")
    where = f"primary_name ILIKE '%{PEOPLE_SEARCH}%'"
    order = f"CASE WHEN primary_name ILIKE '{PEOPLE_SEARCH}%' THEN 0 ELSE 1 END, primary_name, nconst"
    pages.append(f"""
(SELECT '{PEOPLE_SEARCH}' AS query, row_number() OVER (ORDER BY {order}) AS place, nconst AS id, primary_name AS title,
  birth_year AS year, CAST(NULL AS DOUBLE) AS rating, CAST(NULL AS BIGINT) AS votes,
  (SELECT count(*) FROM person WHERE {where}) > 20 AS has_more FROM person WHERE {where} ORDER BY {order} LIMIT 20)""")
    return sql("card person", "\nUNION ALL\n".join(pages))


def _facets() -> str:
    """Counts of facet values under each set of filters."""
    parts = []
    for i, wanted in enumerate(FACETS):
        types = {"movie": "('movie', 'tvMovie')", "tv": "('tvSeries', 'tvMiniSeries')"}[wanted.get("kind", "movie")]
        where = [f"title_type IN {types}", "num_votes >= 50"]
        where += [] if wanted.get("include_adult") else ["NOT is_adult"]
        where += [f"start_year = {wanted['year']}"] if "year" in wanted else []
        where += [f"average_rating >= {wanted['min_rating']}"] if "min_rating" in wanted else []
        if "genre" in wanted:
            where.append(f"tconst IN (SELECT tconst FROM title_genre JOIN genre USING (genre_id) WHERE name = '{wanted['genre']}')")
        rows = f"(SELECT * FROM title JOIN rating USING (tconst) WHERE {' AND '.join(where)})"
        kind = wanted.get("kind", "movie")
        parts += [
            f"SELECT '{i}' AS filters, '{facet}' AS facet, CAST({value} AS VARCHAR) AS value, count(*) AS titles FROM {rows} AS t {join} WHERE {value} IS NOT NULL GROUP BY 3"
            for facet, value, join in [
                ("kind", f"'{kind}'", ""), ("decade", "(start_year // 10) * 10", ""), ("adult", "is_adult", ""),
                ("genre", "name", "JOIN title_genre USING (tconst) JOIN genre USING (genre_id)"),
            ]
        ]
    return sql("title rating genre title_genre", "\nUNION ALL\n".join(parts))


GONE = """
  gone_title AS (SELECT tconst FROM title WHERE title_type = 'videoGame'),
  gone_person AS (SELECT nconst FROM person WHERE nconst NOT IN (SELECT nconst FROM solvent)),
  left_principal AS (SELECT * FROM principal WHERE tconst NOT IN (FROM gone_title) AND nconst NOT IN (FROM gone_person))
"""


def _gone(tables: str, body: str) -> str:
    head = sql(tables, "")
    return f"{head.strip()},{GONE}\n{body.strip()}"


# Normalised payload of a title, as the adapter writes it.
ITEM = """
SELECT tconst AS key, CAST(substr(tconst, 3) AS BIGINT) AS id,
  CASE WHEN title_type = 'tvSeries' THEN 'tv' ELSE 'movie' END AS media_type,
  primary_title AS title, original_title, start_year AS year,
  CASE WHEN title_type = 'tvSeries' THEN coalesce(runtime_minutes, 45) ELSE coalesce(runtime_minutes, 0) END AS runtime,
  '{base}/w500' || poster_url AS poster,
  CASE WHEN is_adult THEN '{base}/w1280/b' || tconst END AS backdrop,
  CAST(average_rating AS DOUBLE) AS rating, num_votes AS votes, '' AS overview, is_adult AS adult,
  CAST(0 AS BIGINT) AS genre_ids, coalesce(array_to_string(g.names, '|'), '') AS genres
FROM title t LEFT JOIN rating r USING (tconst) LEFT JOIN genres g USING (tconst)
""".replace("{base}", IMAGE_BASE)

JOB = "CASE category WHEN 'director' THEN 'Director' WHEN 'writer' THEN 'Story' WHEN 'producer' THEN 'Producer' WHEN 'composer' THEN 'Composer' END"
DEPARTMENT = "CASE category WHEN 'director' THEN 'Directing' WHEN 'writer' THEN 'Writing' WHEN 'producer' THEN 'Production' WHEN 'composer' THEN 'Other' END"
LOCAL_NAME = "CAST(substr(nconst, 3) AS BIGINT)"
CHARACTER = "coalesce(characters ->> '$[0]', '')"
LOCAL_TITLE = "CAST(substr(tconst, 3) AS BIGINT)"
RESPONSE_ENTRIES = f"""
, entry AS (
  SELECT {LOCAL_TITLE} AS id, CASE title_type WHEN 'videoGame' THEN 'game' WHEN 'tvSeries' THEN 'tv' ELSE 'movie' END AS kind,
    primary_title AS title, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS profile FROM title
  UNION ALL SELECT {LOCAL_NAME}, 'person', NULL, primary_name, '{IMAGE_BASE}/w185/f' || nconst FROM person)"""

ORACLE = {
    # Loading
    "dump_roundtrip": sql(
        "title genre title_genre genres",
        r"""
SELECT tconst, title_type, primary_title, '"' || original_title || '\' AS original_title, is_adult,
  start_year, end_year, runtime_minutes, genres || ', ,' || names[1] AS genres
FROM title LEFT JOIN genres USING (tconst)""",
    ),
    "load_clean_nulls": sql(
        "title",
        """
SELECT tconst, CAST(start_year AS VARCHAR) AS "startYear", CAST(end_year AS VARCHAR) AS "endYear",
  CAST(runtime_minutes AS VARCHAR) AS "runtimeMinutes" FROM title""",
    ),
    "load_scrub_text": "SELECT doc_id, translate(text, chr(9) || chr(10), '  ') AS text FROM documents",
    "load_flag_decode": sql("title", "SELECT tconst, is_adult FROM title"),
    "load_titles": sql(
        "title",
        r"""
SELECT tconst, title_type, primary_title, '"' || original_title || '\' AS original_title, is_adult,
  start_year, end_year, runtime_minutes, CAST(NULL AS VARCHAR) AS poster_url FROM title""",
    ),
    "load_genre_explode": sql(
        "title title_genre genre genres",
        """
SELECT tconst, name FROM title JOIN title_genre USING (tconst) JOIN genre USING (genre_id)
UNION ALL SELECT tconst, names[1] FROM title JOIN genres USING (tconst)""",
    ),
    "load_genre_dim": sql("genre", "SELECT genre_id, name FROM genre"),
    "load_title_genre": sql("title title_genre", "SELECT tconst, genre_id FROM title_genre SEMI JOIN title USING (tconst)"),
    "load_ratings": sql(
        "title rating",
        """
SELECT tconst, CAST(average_rating AS DOUBLE) AS average_rating, num_votes
FROM rating JOIN title USING (tconst) WHERE title_type <> 'videoGame'""",
    ),
    "load_people": sql(
        "person solvent",
        """
SELECT nconst, CASE WHEN nconst IN (SELECT nconst FROM solvent) THEN primary_name ELSE 'Unknown' END AS primary_name,
  birth_year, death_year FROM person""",
    ),
    "load_principals": sql(
        "title credit solvent",
        """
SELECT tconst, ordering, nconst,
  CASE WHEN category IS NULL OR category = 'composer' THEN 'unknown' ELSE category END AS category, job, characters
FROM credit
WHERE EXISTS (SELECT 1 FROM title t WHERE t.tconst = credit.tconst AND title_type <> 'videoGame')
  AND EXISTS (SELECT 1 FROM solvent s WHERE s.nconst = credit.nconst)
QUALIFY row_number() OVER (PARTITION BY tconst, ordering
                           ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1""",
    ),
    "load_episodes": sql(
        "title episode",
        """
SELECT e.tconst, parent_tconst, season_number, episode_number FROM episode e
WHERE e.tconst IN (SELECT tconst FROM title WHERE NOT is_adult)
  AND parent_tconst IN (SELECT tconst FROM title WHERE NOT is_adult)""",
    ),
    "table_counts": sql(
        " ".join(NAMES),
        " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in NAMES),
    ),
    # Merging and checking
    "upsert_links": sql(
        "link_change old_link",
        """
, latest AS (
  SELECT tconst, platform, url FROM link_change WHERE platform <> '' AND url <> ''
  QUALIFY row_number() OVER (PARTITION BY tconst, platform ORDER BY ts DESC, event_id DESC) = 1)
SELECT * FROM latest
UNION ALL SELECT tconst, platform, url FROM old_link ANTI JOIN latest USING (tconst, platform)""",
    ),
    "link_rejects": sql(
        "link_change",
        """
SELECT event_id, tconst, platform, url FROM link_change
WHERE NOT coalesce(platform <> '' AND url <> '', false)""",
    ),
    "insert_missing_principals": sql(
        "title credit principal",
        """
SELECT tconst, ordering, nconst, category,
  CASE WHEN title_type = 'movie' THEN 'kept' ELSE job END AS job, characters
FROM principal LEFT JOIN title USING (tconst)""",
    ),
    "resolve_poster": sql(
        "title",
        f"""
SELECT tconst, coalesce(poster_url, url, 'none') AS poster_url
FROM title LEFT JOIN (SELECT {ident('tt', 'o_orderkey')} AS tconst, 'https://found.example/' || o_orderkey AS url
                      FROM orders WHERE o_orderstatus = 'F') USING (tconst)""",
    ),
    "check_pk": sql(
        "credit", "SELECT tconst, ordering, count(*) AS rows FROM credit GROUP BY ALL HAVING count(*) > 1"
    ),
    "check_fk": sql(
        "principal solvent",
        "SELECT nconst, count(*) AS rows FROM principal ANTI JOIN solvent USING (nconst) GROUP BY nconst",
    ),
    "check_unique": "SELECT p_name, count(*) AS rows FROM part GROUP BY p_name HAVING count(*) > 1",
    "check_not_null": sql(
        "title",
        _not_null("title", REQUIRED["title"] + ["start_year", "end_year", "runtime_minutes", "poster_url"]),
    ),
    "check_domain": """
SELECT 'p_name longer than 10' AS rule, count(*) AS violations FROM part WHERE length(p_name) > 10
UNION ALL SELECT 'p_type longer than 5', count(*) FROM part WHERE length(p_type) > 5
UNION ALL SELECT 'average_rating out of range', count(*) FROM part WHERE CAST(p_retailprice AS DECIMAL(12,2)) >= 999.50""".strip(),
    "violations": _violations(" ".join(NAMES) + " solvent", {"person": EVERYONE}),
    "cascade_delete": _gone("title person solvent principal", "SELECT tconst, ordering, nconst FROM left_principal"),
    "cascade_delete_counts": _gone(
        " ".join(NAMES) + " solvent",
        """
SELECT 'title' AS table_name, count(*) AS row_count FROM title WHERE tconst NOT IN (FROM gone_title)
UNION ALL SELECT 'person', count(*) FROM person WHERE nconst NOT IN (FROM gone_person)
UNION ALL SELECT 'episode', count(*) FROM episode
  WHERE tconst NOT IN (FROM gone_title) AND parent_tconst NOT IN (FROM gone_title)
UNION ALL SELECT 'principal', count(*) FROM left_principal
UNION ALL SELECT 'genre', count(*) FROM genre
UNION ALL SELECT 'title_genre', count(*) FROM title_genre WHERE tconst NOT IN (FROM gone_title)
UNION ALL SELECT 'rating', count(*) FROM rating WHERE tconst NOT IN (FROM gone_title)
UNION ALL SELECT 'streaming_link', count(*) FROM streaming_link WHERE tconst NOT IN (FROM gone_title)""",
    ),
    # Browsing
    "home_top_rated": sql(
        "card",
        f"""
SELECT {HOME} FROM card WHERE {STANDALONE} AND votes >= 25000 AND NOT is_adult
ORDER BY rating DESC, votes DESC, id LIMIT 50""",
    ),
    "home_most_voted": sql(
        "card", f"SELECT {HOME} FROM card WHERE {STANDALONE} AND NOT is_adult ORDER BY votes DESC, id LIMIT 50"
    ),
    "home_with_adult": sql(
        "card",
        f"SELECT {HOME} FROM card WHERE {STANDALONE} AND votes >= 25000 ORDER BY rating DESC, votes DESC, id LIMIT 20",
    ),
    "hero_list": sql(
        "card",
        f"""
SELECT {CARD} FROM (SELECT * FROM card WHERE {STANDALONE} AND NOT is_adult ORDER BY votes DESC, id LIMIT 5)
WHERE poster IS NOT NULL""",
    ),
    "title_genres_string": sql(
        "title genres", "SELECT tconst, coalesce(genres, '') AS genres FROM title LEFT JOIN genres USING (tconst)"
    ),
    "title_summary": sql(
        "title rating",
        """
SELECT tconst, primary_title, original_title, title_type, start_year, end_year, runtime_minutes, is_adult,
  CAST(average_rating AS DOUBLE) AS average_rating, num_votes
FROM title LEFT JOIN rating USING (tconst)""",
    ),
    "title_crew": sql(
        "named",
        "SELECT tconst, nconst, name, category, ordering FROM named WHERE category IN ('director', 'writer')",
    ),
    "top_cast": sql(
        "named",
        """
SELECT tconst, nconst, name, characters, ordering FROM named WHERE category IN ('actor', 'actress')
QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY ordering) <= 5""",
    ),
    "full_credits": sql(
        "named",
        f"""
SELECT tconst, category, nconst, name, job, characters, ordering, {rank('category', CREDIT_ROLES)} AS rank FROM named
ORDER BY tconst, rank, ordering""",
    ),
    "series_seasons": sql(
        "episode", "SELECT DISTINCT parent_tconst, season_number FROM episode WHERE season_number IS NOT NULL"
    ),
    "series_episodes": sql(
        "episode title rating",
        """
SELECT parent_tconst, e.tconst, primary_title, season_number, episode_number, start_year, runtime_minutes,
  CAST(average_rating AS DOUBLE) AS average_rating, num_votes
FROM episode e JOIN title t USING (tconst) LEFT JOIN rating r USING (tconst) WHERE season_number = 3""",
    ),
    "episodes_all_seasons": sql(
        "episode title rating",
        """
SELECT parent_tconst, e.tconst, primary_title, season_number, episode_number, start_year, runtime_minutes,
  CAST(average_rating AS DOUBLE) AS average_rating, num_votes
FROM episode e JOIN title t USING (tconst) LEFT JOIN rating r USING (tconst)""",
    ),
    "person_info": sql("person", "SELECT nconst, primary_name, birth_year, death_year FROM person"),
    "filmography": sql(
        "film",
        f"""
SELECT *, {rank('category', FILMOGRAPHY_ROLES)} AS rank FROM film
ORDER BY nconst, rank, start_year DESC NULLS LAST, tconst, ordering""",
    ),
    **{
        f"filmography_top{n}": sql(
            "film",
            f"""
SELECT * FROM film QUALIFY row_number() OVER (
  PARTITION BY nconst, category ORDER BY start_year DESC NULLS LAST, tconst, ordering) <= {n}""",
        )
        for n in (50, 20)
    },
    "search_titles": search(
        FOUND.format(q=SEARCH), f"CASE WHEN title ILIKE '{SEARCH}%' THEN 0 ELSE 1 END, votes DESC NULLS LAST, id"
    ),
    "search_prefix_rank": search(
        FOUND.format(q="re"), "CASE WHEN title ILIKE 're%' THEN 0 ELSE 1 END, votes DESC NULLS LAST, id"
    ),
    "search_titles_route": search(FOUND.format(q=SEARCH), "votes DESC NULLS LAST, id"),
    "search_literal": search(
        "contains(lower(title), 'd w') AND type <> 'tvEpisode'",
        "CASE WHEN starts_with(lower(title), 'd w') THEN 0 ELSE 1 END, votes DESC NULLS LAST, id",
    ),
    "search_backslash": search(
        FOUND.format(q="D_r%1"), "CASE WHEN title ILIKE 'D_r%1%' THEN 0 ELSE 1 END, votes DESC NULLS LAST, id"
    ),
    "search_wildcard": search(
        FOUND.format(q="D_r%1"), "CASE WHEN title ILIKE 'D_r%1%' THEN 0 ELSE 1 END, votes DESC NULLS LAST, id"
    ),
    "search_page2": search(
        FOUND.format(q=SEARCH),
        f"CASE WHEN title ILIKE '{SEARCH}%' THEN 0 ELSE 1 END, votes DESC NULLS LAST, id",
        page=2,
    ),
    "search_people": sql(
        "person",
        f"""
SELECT nconst AS id, primary_name AS name, birth_year, death_year, 'person' AS result_type,
  row_number() OVER (ORDER BY CASE WHEN primary_name ILIKE '{PEOPLE_SEARCH}%' THEN 0 ELSE 1 END, primary_name, nconst) AS place,
  (SELECT count(*) FROM person WHERE primary_name ILIKE '%{PEOPLE_SEARCH}%') > 40 AS has_more,
  2 + CAST((SELECT count(*) FROM person WHERE primary_name ILIKE '%{PEOPLE_SEARCH}%') > 40 AS BIGINT) AS total_pages
FROM person WHERE primary_name ILIKE '%{PEOPLE_SEARCH}%'
ORDER BY CASE WHEN primary_name ILIKE '{PEOPLE_SEARCH}%' THEN 0 ELSE 1 END, primary_name, nconst LIMIT 20 OFFSET 20""",
    ),
    "search_multi": sql(
        "card person",
        f"""
, titles AS (
  SELECT {CARD}, 'title' AS result_type,
    row_number() OVER (ORDER BY CASE WHEN title ILIKE '{SEARCH}%' THEN 0 ELSE 1 END, votes DESC NULLS LAST, id) AS place
  FROM card WHERE {FOUND.format(q=SEARCH)}
  ORDER BY CASE WHEN title ILIKE '{SEARCH}%' THEN 0 ELSE 1 END, votes DESC NULLS LAST, id LIMIT 20),
people AS (
  SELECT nconst AS id, primary_name AS name, birth_year, death_year, 'person' AS result_type,
    row_number() OVER (ORDER BY CASE WHEN primary_name ILIKE '{PEOPLE_SEARCH}%' THEN 0 ELSE 1 END, primary_name, nconst) AS place
  FROM person WHERE primary_name ILIKE '%{PEOPLE_SEARCH}%'
  ORDER BY CASE WHEN primary_name ILIKE '{PEOPLE_SEARCH}%' THEN 0 ELSE 1 END, primary_name, nconst LIMIT 20)
SELECT * FROM titles UNION ALL BY NAME SELECT * FROM people""",
    ),
    "discover": sql(
        "card title_genre genre",
        f"""
SELECT {HOME} FROM card
WHERE type IN ('movie', 'tvMovie') AND NOT is_adult AND votes >= 50 AND year = {DISCOVER['year']}
  AND rating >= {DISCOVER['min_rating']}
  AND id IN (SELECT tconst FROM title_genre JOIN genre USING (genre_id) WHERE name = '{DISCOVER['genre']}')
ORDER BY votes DESC, id LIMIT 20""",
    ),
    "discover_by_rating": sql(
        "card",
        f"""
SELECT {HOME} FROM card WHERE type IN ('tvSeries', 'tvMiniSeries') AND NOT is_adult AND votes >= 50
ORDER BY rating DESC, id LIMIT 20 OFFSET 40""",
    ),
    "discover_after": sql(
        "card",
        f"""
SELECT {CARD} FROM card
WHERE type IN ('movie', 'tvMovie') AND NOT is_adult AND votes >= 50
  AND (votes < {AFTER[0]} OR votes = {AFTER[0]} AND id > '{AFTER[1]}')
ORDER BY votes DESC, id LIMIT 20""",
    ),
    "page_info": sql(
        "card",
        """
SELECT count(*) AS total_results, least(CAST(ceil(count(*) / 20) AS BIGINT), 500) AS total_pages
FROM card WHERE type IN ('movie', 'tvMovie') AND NOT is_adult AND votes >= 50""",
    ),
    "genre_list": sql("genre", "SELECT genre_id AS id, name FROM genre ORDER BY name"),
    "link_display": sql(
        "streaming_link",
        f"SELECT tconst, platform, url, {_platform(0)} AS icon, {_platform(1)} AS color FROM streaming_link",
    ),
    # Documents
    "title_documents": sql(
        "title rating genres named",
        """
, crew AS (
  SELECT tconst,
    string_agg(nconst || ':' || name || ':' || category, '|' ORDER BY ordering) FILTER (category = 'director') AS directors,
    string_agg(nconst || ':' || name || ':' || category, '|' ORDER BY ordering) FILTER (category = 'writer') AS writers
  FROM named GROUP BY tconst),
top AS (
  SELECT * FROM named WHERE category IN ('actor', 'actress')
  QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY ordering) <= 15),
actors AS (
  SELECT tconst, string_agg(nconst || ':' || name || ':' || coalesce(characters, ''), '|' ORDER BY ordering) AS cast_list
  FROM top GROUP BY tconst)
SELECT tconst AS id, primary_title AS title, original_title, title_type AS media_type, start_year AS year, end_year,
  runtime_minutes AS runtime, is_adult AS adult, coalesce(poster_url, 'none') AS poster,
  CAST(average_rating AS DOUBLE) AS rating, num_votes AS votes,
  coalesce(array_to_string(names, '|'), '') AS genres, coalesce(directors, '') AS directors,
  coalesce(writers, '') AS writers, coalesce(cast_list, '') AS cast_list
FROM title LEFT JOIN rating USING (tconst) LEFT JOIN genres USING (tconst)
LEFT JOIN crew USING (tconst) LEFT JOIN actors USING (tconst)""",
    ),
    "credits_by_category": sql(
        "title named",
        """
, part_list AS (
  SELECT tconst, category, min(ordering) AS first,
    string_agg(ordering || ':' || nconst || ':' || name || ':' || coalesce(job, '') || ':' || coalesce(characters, ''),
               '|' ORDER BY ordering) AS credits
  FROM named GROUP BY tconst, category)
SELECT t.tconst AS id, primary_title AS title,
  CASE WHEN category IS NOT NULL THEN row_number() OVER (PARTITION BY t.tconst ORDER BY first) - 1 END AS place,
  category, credits
FROM title t LEFT JOIN part_list USING (tconst)""",
    ),
    "person_documents": sql(
        "film person",
        """
, kept AS (
  SELECT *, row_number() OVER (PARTITION BY nconst ORDER BY start_year DESC NULLS LAST, tconst, ordering) AS spot
  FROM film
  QUALIFY row_number() OVER (PARTITION BY nconst, category ORDER BY start_year DESC NULLS LAST, tconst, ordering) <= 50),
lists AS (
  SELECT nconst, category, min(spot) AS first,
    string_agg(tconst || ':' || primary_title || ':' || title_type || ':' || coalesce(CAST(start_year AS VARCHAR), '')
      || ':' || coalesce(CAST(CAST(average_rating AS DECIMAL(3,1)) AS VARCHAR), '') || ':' || coalesce(characters, ''),
      '|' ORDER BY spot) AS titles
  FROM kept GROUP BY nconst, category)
SELECT p.nconst AS id, primary_name AS name, birth_year, death_year,
  CASE WHEN category IS NOT NULL THEN row_number() OVER (PARTITION BY p.nconst ORDER BY first) - 1 END AS place,
  category, titles
FROM person p LEFT JOIN lists USING (nconst)""",
    ),
    # Analysis
    "ratings_by_decade": sql(
        "title rating",
        f"""
SELECT (start_year // 10) * 10 AS decade, {mean(f'sum({TENTHS})', 'count(*)')} AS avg_rating, count(*) AS titles_count
FROM title JOIN rating USING (tconst)
WHERE start_year >= 1890 AND title_type IN ('movie', 'tvSeries', 'tvMovie') GROUP BY 1 ORDER BY 1""",
    ),
    "decade_counts": sql(
        "title",
        """
SELECT (start_year // 10) * 10 AS decade, count(*) AS titles_count FROM title
WHERE start_year IS NOT NULL GROUP BY 1 ORDER BY 1""",
    ),
    "top_directors": sql(
        "principal person rating",
        f"""
SELECT primary_name, {mean(f'sum({TENTHS})', 'count(*)')} AS avg_director_rating, count(*) AS movie_count
FROM principal JOIN person USING (nconst) JOIN rating USING (tconst)
WHERE category = 'director' GROUP BY primary_name HAVING count(*) >= {DIRECTOR_MIN}
ORDER BY avg_director_rating DESC, primary_name LIMIT 20""",
    ),
    "genre_popularity": sql(
        "title genre title_genre",
        f"""
SELECT name AS genre, (start_year // 10) * 10 AS decade, count(*) AS titles_count
FROM title JOIN title_genre USING (tconst) JOIN genre USING (genre_id)
WHERE start_year >= 1950 AND title_type IN ('movie', 'tvSeries', 'tvMovie')
  AND name IN (SELECT name FROM title_genre JOIN genre USING (genre_id) GROUP BY name HAVING count(*) >= {GENRE_MIN_LINKS})
GROUP BY 1, 2 ORDER BY 1, 2""",
    ),
    "prolific_actors": sql(
        "principal person rating",
        f"""
SELECT primary_name, count(DISTINCT tconst) AS roles_count,
  {mean(f'sum({TENTHS})', 'count(average_rating)')} AS avg_rating
FROM principal JOIN person USING (nconst) LEFT JOIN rating USING (tconst)
WHERE category IN ('actor', 'actress') GROUP BY primary_name
HAVING count(DISTINCT tconst) >= {ACTOR_MIN_TITLES} ORDER BY roles_count DESC, primary_name LIMIT 20""",
    ),
    # Display and payloads
    "scalar_display": sql(
        "title rating",
        f"""
SELECT tconst, CAST(average_rating AS VARCHAR) AS rating_text, format('{{:,}}', num_votes) AS votes_text,
  lower(primary_title) AS normal, true AS is_title, false AS is_person, start_year AS year,
  {encoded("primary_title || ' (a&b)!*''~/é'")} AS encoded
FROM title LEFT JOIN rating USING (tconst)""",
    ),
    "short_overviews": "SELECT doc_id, substr(text, 1, 160) AS overview FROM documents",
    "character_first": sql("principal", "SELECT tconst, ordering, characters ->> '$[0]' AS character FROM principal"),
    "image_urls": sql(
        "title",
        f"""
SELECT tconst, '{IMAGE_BASE}/w500' || poster_url AS poster, '{IMAGE_BASE}/w1280' || poster_url AS backdrop,
  'http://images.example' || poster_url AS absolute FROM title""",
    ),
    "provider_links": sql(
        "title",
        f"""
, named AS (
  SELECT event_id, {ident('tt', 'user_id')} AS tconst,
    list_value({', '.join(map(quoted, PROVIDER_NAMES))})[event_id % {len(PROVIDER_NAMES)} + 1] AS provider
  FROM events)
SELECT event_id, provider,
  replace(replace({_provider_case()}, '{{t}}', {encoded('primary_title')}), '{{n}}', {encoded('provider')}) AS link
FROM named JOIN title USING (tconst)""",
    ),
    "payload_titles": sql("title rating genres", ITEM),
    "payload_people": sql(
        "role person",
        f"""
, near AS (
  SELECT *, row_number() OVER (PARTITION BY nconst ORDER BY tconst, ordering) AS spot FROM (
    SELECT * FROM role)
  QUALIFY spot <= 3)
SELECT p.nconst AS key, {LOCAL_NAME} AS id, primary_name AS name,
  CASE WHEN death_year IS NULL THEN '{IMAGE_BASE}/w185/f' || p.nconst || '.jpg' END AS profile,
  'person' AS media_type, '' AS known_for_department,
  coalesce((SELECT string_agg(CAST(substr(n.tconst, 3) AS BIGINT) || ':' || primary_title || ':' || kind || ':'
                     || coalesce(CAST(start_year AS VARCHAR), ''), '|' ORDER BY spot)
            FROM near n WHERE n.nconst = p.nconst), '') AS known_for
FROM person p""",
    ),
    "payload_cast": sql(
        "named",
        f"""
SELECT tconst AS key, row_number() OVER (PARTITION BY tconst ORDER BY ordering) - 1 AS place, {LOCAL_NAME} AS id, name,
  {CHARACTER} AS character,
  CASE WHEN ordering % 2 = 1 THEN '{IMAGE_BASE}/w185/f' || nconst || '.jpg' END AS profile
FROM named WHERE category IN ('actor', 'actress')
QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY ordering) <= 20""",
    ),
    "payload_crew": sql(
        "title named",
        f"""
SELECT t.tconst AS key,
  coalesce(string_agg({LOCAL_NAME} || ':' || name, '|' ORDER BY ordering) FILTER (category = 'director'), '') AS directors,
  coalesce(string_agg({LOCAL_NAME} || ':' || name, '|' ORDER BY ordering) FILTER (category = 'writer'), '') AS writers
FROM title t LEFT JOIN named USING (tconst) GROUP BY t.tconst""",
    ),
    "payload_departments": sql(
        "title named",
        f"""
SELECT tconst AS key, row_number() OVER (PARTITION BY tconst ORDER BY min(ordering)) - 1 AS place,
  {DEPARTMENT} AS department,
  string_agg({LOCAL_NAME} || ':' || name || ':' || {JOB}, '|' ORDER BY ordering) AS crew
FROM named WHERE {JOB} IS NOT NULL AND tconst IN (SELECT tconst FROM title) GROUP BY tconst, {DEPARTMENT}""",
    ),
    "payload_providers": sql(
        "title streaming_link",
        f"""
SELECT t.tconst AS key,
  CASE WHEN count(platform) > 0 THEN 'https://gb.example' ELSE '' END AS watch_link,
  coalesce(string_agg(platform || ':{IMAGE_BASE}/w92/l' || platform || '.png', '|' ORDER BY platform), '') AS providers
FROM title t LEFT JOIN streaming_link USING (tconst) GROUP BY t.tconst""",
    ),
    "payload_filmography": sql(
        "role",
        f"""
, placed AS (
  SELECT *, row_number() OVER (PARTITION BY nconst ORDER BY start_year DESC NULLS LAST, tconst, ordering) - 1 AS place
  FROM role)
SELECT nconst AS key, place, CAST(substr(tconst, 3) AS BIGINT) AS id, kind AS media_type, primary_title AS title,
  CAST(start_year AS VARCHAR) AS year, {CHARACTER} AS character, CAST(NULL AS VARCHAR) AS poster,
  average_rating AS rating
FROM placed WHERE place < 60""",
    ),
    "payload_similar": sql(
        "title genres",
        """
, entry AS (
  SELECT tconst, title_type, unnest(names) AS name, generate_subscripts(names, 1) AS n
  FROM title JOIN genres USING (tconst))
SELECT tconst AS key, n - 1 AS place, n - 1 AS id,
  CASE WHEN title_type = 'tvSeries' THEN name || ' series' ELSE name END AS title,
  CASE WHEN title_type = 'tvSeries' THEN 'tv' ELSE 'movie' END AS media_type,
  CAST(NULL AS BIGINT) AS year, false AS adult
FROM entry WHERE n <= 10""",
    ),
    "payload_documents": sql(
        "title genres named streaming_link",
        f"""
, actors AS (
  SELECT tconst, string_agg({LOCAL_NAME} || ':' || name || ':' || {CHARACTER}, '|' ORDER BY ordering) AS cast_list
  FROM (SELECT * FROM named WHERE category IN ('actor', 'actress')
        QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY ordering) <= 20) GROUP BY tconst),
crew AS (
  SELECT tconst,
    string_agg({LOCAL_NAME} || ':' || name, '|' ORDER BY ordering) FILTER (category = 'director') AS directors,
    string_agg({LOCAL_NAME} || ':' || name, '|' ORDER BY ordering) FILTER (category = 'writer') AS writers
  FROM named GROUP BY tconst),
platforms AS (
  SELECT tconst, string_agg(platform || ':{IMAGE_BASE}/w92/l' || platform || '.png', '|' ORDER BY platform) AS providers
  FROM streaming_link GROUP BY tconst),
near AS (
  SELECT tconst, string_agg((n - 1) || ':' || name || CASE WHEN title_type = 'tvSeries' THEN ' series' ELSE '' END,
                            '|' ORDER BY n) AS similar_list
  FROM (SELECT tconst, title_type, unnest(names) AS name, generate_subscripts(names, 1) AS n
        FROM title JOIN genres USING (tconst)) WHERE n <= 10 GROUP BY tconst)
SELECT t.tconst AS key, CAST(substr(t.tconst, 3) AS BIGINT) AS id, primary_title AS title,
  CASE WHEN title_type = 'tvSeries' THEN 'tv' ELSE 'movie' END AS media_type,
  coalesce(cast_list, '') AS cast_list, coalesce(directors, '') AS directors, coalesce(writers, '') AS writers,
  coalesce(providers, '') AS providers, coalesce(similar_list, '') AS similar_list,
  CASE WHEN providers IS NOT NULL THEN 'https://gb.example' ELSE '' END AS watch_link, '' AS tagline, '' AS status
FROM title t LEFT JOIN actors USING (tconst) LEFT JOIN crew USING (tconst) LEFT JOIN platforms USING (tconst)
LEFT JOIN near USING (tconst)""",
    ),
    "payload_credits": sql(
        "title named",
        f"""
, actors AS (
  SELECT tconst, string_agg({LOCAL_NAME} || ':' || name || ':' || {CHARACTER}, '|' ORDER BY ordering) AS cast_list
  FROM named WHERE category IN ('actor', 'actress') GROUP BY tconst),
members AS (
  SELECT tconst, {DEPARTMENT} AS department, min(ordering) AS first,
    string_agg({LOCAL_NAME} || ':' || name || ':' || {JOB}, '|' ORDER BY ordering) AS crew
  FROM named WHERE {JOB} IS NOT NULL GROUP BY 1, 2),
departments AS (
  SELECT tconst, string_agg(department || '=' || crew, ';' ORDER BY first) AS departments FROM members GROUP BY tconst)
SELECT t.tconst AS key, CAST(substr(t.tconst, 3) AS BIGINT) AS id, primary_title AS title,
  coalesce(cast_list, '') AS cast_list, coalesce(departments, '') AS departments
FROM title t LEFT JOIN actors USING (tconst) LEFT JOIN departments USING (tconst)""",
    ),
    "payload_person_documents": sql(
        "role person",
        f"""
, placed AS (
  SELECT *, row_number() OVER (PARTITION BY nconst ORDER BY start_year DESC NULLS LAST, tconst, ordering) AS place
  FROM role QUALIFY place <= 60),
lists AS (
  SELECT nconst, string_agg(CAST(substr(tconst, 3) AS BIGINT) || ':' || primary_title || ':'
    || coalesce(CAST(start_year AS VARCHAR), ''), '|' ORDER BY place) AS filmography FROM placed GROUP BY nconst)
SELECT p.nconst AS key, {LOCAL_NAME} AS id, primary_name AS name,
  CASE WHEN death_year IS NULL THEN '{IMAGE_BASE}/w500/f' || p.nconst || '.jpg' END AS profile,
  '' AS biography, CAST(NULL AS VARCHAR) AS birthday, CAST(NULL AS VARCHAR) AS deathday, '' AS place_of_birth,
  '' AS known_for_department, coalesce(filmography, '') AS filmography
FROM person p LEFT JOIN lists USING (nconst)""",
    ),
    "search_payloads": sql(
        "title person",
        f"""
SELECT tconst AS key, CASE WHEN title_type = 'tvSeries' THEN 'tv' ELSE 'movie' END AS media_type,
  CAST(substr(tconst, 3) AS BIGINT) AS id, primary_title AS title, CAST(NULL AS VARCHAR) AS name,
  CAST(NULL AS VARCHAR) AS profile, start_year AS year
FROM title WHERE title_type <> 'videoGame'
UNION ALL
SELECT nconst, 'person', {LOCAL_NAME}, NULL, primary_name,
  CASE WHEN death_year IS NULL THEN '{IMAGE_BASE}/w185/f' || nconst || '.jpg' END, NULL
FROM person""",
    ),
    "payload_results": sql(
        "title person",
        f"""
{RESPONSE_ENTRIES}
SELECT CAST(id // 20 AS VARCHAR) AS key, row_number() OVER (PARTITION BY id // 20 ORDER BY id DESC, kind) - 1 AS place,
  id, kind AS media_type, title, name, profile
FROM entry WHERE kind <> 'game'""",
    ),
    "payload_pages": sql(
        "title person",
        f"""
{RESPONSE_ENTRIES}
SELECT CAST(id // 20 AS VARCHAR) AS key, id // 20 AS page, least(id // 20 * 10, 500) AS total_pages,
  CASE WHEN id // 20 % 2 = 0 THEN count(*) ELSE 0 END AS total_results
FROM entry GROUP BY id // 20""",
    ),
    "payload_listing": sql(
        "title person",
        f"""
{RESPONSE_ENTRIES}
, placed AS (SELECT *, row_number() OVER (PARTITION BY id // 20 ORDER BY id DESC, kind) - 1 AS place FROM entry)
SELECT CAST(id // 20 AS VARCHAR) AS key, place, id, 'tv' AS media_type,
  coalesce(CASE WHEN kind = 'tv' THEN title END, name, '') AS title
FROM placed WHERE place < 5""",
    ),
    "payload_rejects": sql("title", f"SELECT tconst AS key FROM title WHERE {LOCAL_TITLE} % 11 = 0"),
    "poster_lookup": sql(
        "title",
        f"""
, found AS (
  SELECT *, {LOCAL_TITLE} AS n FROM title)
SELECT tconst, coalesce(poster_url, CASE
  WHEN n % 11 = 0 THEN 'none'
  WHEN title_type = 'movie' AND n % 2 = 0 THEN '{IMAGE_BASE}/w500/m' || n
  WHEN n % 5 = 0 THEN '{IMAGE_BASE}/w500/s' || n
  WHEN n % 7 <> 0 THEN '{IMAGE_BASE}/w500/e' || n
  ELSE 'none' END) AS poster_url
FROM found""",
    ),
    "series_documents": sql(
        "episode title rating",
        """
, parts AS (
  SELECT parent_tconst, season_number, string_agg(
      episode_number || ':' || e.tconst || ':' || primary_title || ':' || coalesce(CAST(start_year AS VARCHAR), '')
      || ':' || coalesce(CAST(runtime_minutes AS VARCHAR), '') || ':' || coalesce(CAST(average_rating AS VARCHAR), '')
      || ':' || coalesce(CAST(num_votes AS VARCHAR), ''), '|' ORDER BY episode_number, e.tconst) AS episodes
  FROM episode e JOIN title t USING (tconst) LEFT JOIN rating r USING (tconst) GROUP BY ALL),
lists AS (
  SELECT parent_tconst, string_agg(season_number, '|' ORDER BY season_number) AS seasons
  FROM (SELECT DISTINCT parent_tconst, season_number FROM episode) GROUP BY parent_tconst)
SELECT t.tconst AS id, primary_title AS title, coalesce(seasons, '') AS seasons, season_number AS season,
  coalesce(episodes, '') AS episodes
FROM title t LEFT JOIN lists l ON l.parent_tconst = t.tconst LEFT JOIN parts p ON p.parent_tconst = t.tconst""",
    ),
    "cascade_genres": sql(
        "genre title_genre",
        f"""
SELECT tconst, genre_id FROM title_genre
WHERE genre_id NOT IN (SELECT genre_id FROM genre WHERE name LIKE '{GENRES_GONE}%')""",
    ),
    "trending_window": f"""
SELECT {ident('tt', 'user_id')} AS tconst, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, count(*) AS views
FROM events GROUP BY ALL""".strip(),
    "debtor_filmography": sql("film solvent", "SELECT film.* FROM film ANTI JOIN solvent USING (nconst)"),
}
# The stream and the batch merge end in the same table.
ORACLE["stream_upsert_links"] = ORACLE["upsert_links"]
ORACLE["reload_catalogue"] = ORACLE["cascade_delete_counts"]
ORACLE["stream_fold_links"] = ORACLE["upsert_links"]
ORACLE["discover_facets"] = _facets()
ORACLE["page_jumps"] = sql(
    "title rating",
    """
, listed AS (
  SELECT tconst AS id, primary_title AS title, num_votes AS votes, row_number() OVER (ORDER BY num_votes DESC, tconst) AS place
  FROM title JOIN rating USING (tconst) WHERE title_type IN ('movie', 'tvMovie') AND NOT is_adult AND num_votes >= 50),
whole AS (SELECT count(*) AS n, (count(*) + 19) // 20 AS last FROM listed)
SELECT id, title, votes, place, n > page * 20 AS has_more, page + CAST(n > page * 20 AS BIGINT) AS total_pages, page
FROM whole, (SELECT DISTINCT unnest([1, 2, last // 2, last]) AS page FROM whole) JOIN listed ON (place - 1) // 20 + 1 = page""",
)
ORACLE["filmography_copy"] = f"SELECT * EXCLUDE (rank) FROM ({ORACLE['filmography']}) WHERE nconst IN ('nm0000001', 'nm0000007')"
ORACLE["stream_load"] = sql(
    "title rating credit episode genre title_genre",
    """
SELECT tconst, 'rating' AS kind, CAST(NULL AS VARCHAR) AS other, num_votes AS n FROM rating SEMI JOIN title USING (tconst)
UNION ALL SELECT tconst, 'credit', min(nconst), ordering FROM credit SEMI JOIN title USING (tconst) GROUP BY tconst, ordering
UNION ALL SELECT tconst, 'episode', parent_tconst, episode_number FROM episode SEMI JOIN title USING (tconst)
  WHERE parent_tconst IN (SELECT tconst FROM title)
UNION ALL SELECT tconst, 'genre', name, NULL FROM title_genre JOIN genre USING (genre_id) SEMI JOIN title USING (tconst)
UNION ALL SELECT tconst, 'title', primary_title, start_year FROM title""",
)
ORACLE["payload_parsed"] = ORACLE["payload_titles"]
ORACLE["stream_compacted_links"] = ORACLE["upsert_links"]
ORACLE["violations_delta"] = _violations(" ".join(NAMES), MERGED)
ORACLE["trend_states"] = _trends()
ORACLE["search_indexed"] = _indexed()
ORACLE["merge_catalogue"] = sql(
    "rating episode title person",
    f"""
SELECT tconst, 'rating' AS kind, CAST(NULL AS VARCHAR) AS other, num_votes AS n, CAST(average_rating AS DOUBLE) AS mean FROM {MERGED['rating']}
UNION ALL SELECT tconst, 'episode', parent_tconst, episode_number, NULL FROM {MERGED['episode']}
UNION ALL SELECT tconst, 'title', title_type, NULL, NULL FROM {MERGED['title']}
UNION ALL SELECT nconst, 'person', primary_name, NULL, NULL FROM {MERGED['person']}""",
)
