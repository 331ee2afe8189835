"""Timings as one JSON line.

``build_catalogue`` derives the eight tables from the test tables and saves them; the
queries then run over the saved catalogue. Everything is run once to warm up; then the
build is timed once and each query three times, of which the median counts. Results are
computed in full and dropped.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from titlelake.schemas import TABLES
from titlelake.session import local_session
from titlelake.sources import testbed
from titlelake.sources.shared import shared_folder
from titlelake.sources.tables import load_catalog, save_catalog
from titlelake.testing.queries import CATALOGUE_QUERIES, QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "home_top_rated", "home_most_voted", "title_genres_string", "title_summary", "top_cast", "full_credits",
    "episodes_all_seasons", "filmography", "filmography_top50", "search_titles", "search_people", "discover",
    "title_documents", "person_documents", "credits_by_category", "ratings_by_decade", "top_directors",
    "genre_popularity", "prolific_actors", "payload_titles",
]
# Jobs over the raw test tables.
RAW = [
    "load_principals", "load_title_genre", "load_episodes", "cascade_delete", "upsert_links", "stream_upsert_links",
    "violations", "check_pk",
]


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    path = shared_folder(spark, "bench")

    def build() -> None:
        save_catalog(testbed.catalogue(spark, SF_DIR), path, list(TABLES))

    build()
    timings = {"build_catalogue": seconds(build)}
    runs = {name: lambda q=CATALOGUE_QUERIES[name]: drain(q(load_catalog(spark, path))) for name in HEADLINE}
    runs |= {name: lambda q=QUERIES[name]: drain(q(spark, SF_DIR)) for name in RAW}
    for name, run in runs.items():
        run()
        timings[name] = statistics.median(seconds(run) for _ in range(3))
    shown = {name: round(value, 3) for name, value in timings.items()}
    scale = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": shown,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
