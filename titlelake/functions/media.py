"""Image addresses, watch-provider links and platform display data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from titlelake.functions.text import norm, url_component

# Image host of the payloads, and the image shown when there is none.
IMAGE_BASE = "https://image.tmdb.org/t/p"
NO_POSTER = "data:image/svg+xml,%3Csvg xmlns='http://www.w3.org/2000/svg'/%3E"

# Icon and colour per watch platform, and for any other platform.
PLATFORMS = {
    "netflix": ("🔴", "#E50914"),
    "amazon": ("📦", "#00A8E1"),
    "disney+": ("🏰", "#113CCF"),
    "hulu": ("💚", "#1CE783"),
    "hbo": ("🟣", "#B028C4"),
    "apple tv+": ("🍎", "#555555"),
    "paramount+": ("⛰️", "#0064FF"),
    "peacock": ("🦚", "#000000"),
    "crunchyroll": ("🟠", "#F47521"),
    "youtube": ("▶️", "#FF0000"),
}
OTHER_PLATFORM = ("🔗", "#666")

# Search address per provider name, in matching order; {t} is the title.
PROVIDER_RULES = [
    ("netflix", "https://www.netflix.com/search?q={t}"),
    ("amazon prime video", "https://www.amazon.com/s?k={t}&i=instant-video"),
    ("amazon video", "https://www.amazon.com/s?k={t}&i=instant-video"),
    ("disney plus", "https://www.disneyplus.com/search/{t}"),
    ("apple tv plus", "https://tv.apple.com/search?term={t}"),
    ("apple tv", "https://tv.apple.com/search?term={t}"),
    ("apple itunes", "https://tv.apple.com/search?term={t}"),
    ("google play movies", "https://play.google.com/store/search?q={t}&c=movies"),
    ("youtube", "https://www.youtube.com/results?search_query={t}+full+movie"),
    ("hulu", "https://www.hulu.com/search?q={t}"),
    ("max", "https://play.max.com/search?q={t}"),
    ("hbo max", "https://play.max.com/search?q={t}"),
    ("paramount plus", "https://www.paramountplus.com/search/?q={t}"),
    ("paramount+ amazon channel", "https://www.paramountplus.com/search/?q={t}"),
    ("peacock", "https://www.peacocktv.com/search?q={t}"),
    ("peacock premium", "https://www.peacocktv.com/search?q={t}"),
    ("crunchyroll", "https://www.crunchyroll.com/search?q={t}"),
    ("vudu", "https://www.vudu.com/content/movies/search?searchString={t}"),
    ("microsoft store", "https://www.microsoft.com/en-us/search/shop/movies-tv?q={t}"),
    ("mubi", "https://mubi.com/en/search?query={t}"),
    ("starz", "https://www.starz.com/search?q={t}"),
]
OTHER_PROVIDER = "https://www.google.com/search?q=watch+{t}+on+{n}"


def image_url(path: Column, size: str = "w500") -> Column:
    """Full image address; null without a path, absolute addresses pass through."""
    return (
        F.when(path.startswith("http"), path)
        .when(path != "", F.concat(F.lit(f"{IMAGE_BASE}/{size}"), path))
    )


def platform_field(platform: Column, field: int) -> Column:
    """Icon (0) or colour (1) of a platform, matched without regard to case."""
    shown = F.create_map(*[F.lit(x) for name, info in PLATFORMS.items() for x in (name, info[field])])
    return F.coalesce(F.try_element_at(shown, F.lower(platform)), F.lit(OTHER_PLATFORM[field]))


def provider_url(provider: Column, title: Column) -> Column:
    """Search address for a title at a provider.

    A rule matches if either text contains the other; the first matching rule wins, so
    an empty provider name takes the first rule. The rules are constants, so this is a
    row-local expression and needs no join.
    """
    name = norm(F.coalesce(provider, F.lit("")))
    chosen = F.lit(None).cast("string")
    for pattern, template in reversed(PROVIDER_RULES):
        matched = F.contains(name, F.lit(pattern)) | F.contains(F.lit(pattern), name)
        chosen = F.when(matched, F.lit(template)).otherwise(chosen)
    chosen = F.coalesce(chosen, F.lit(OTHER_PROVIDER))
    encoded = url_component(F.coalesce(title, F.lit("")))
    # The title goes in first: its encoding escapes braces, so {n} stays unique.
    filled_in = F.replace(chosen, F.lit("{t}"), encoded)
    return F.replace(filled_in, F.lit("{n}"), url_component(F.coalesce(provider, F.lit(""))))
