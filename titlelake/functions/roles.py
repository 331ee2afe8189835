"""Priority of credit categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display priority of categories in full credits and in a filmography.
CREDIT_ROLES = [
    "director", "writer", "actor", "actress", "producer", "composer", "cinematographer", "editor",
]
FILMOGRAPHY_ROLES = ["director", "writer", "actor", "actress", "producer"]

CAST = ["actor", "actress"]
CREW = ["director", "writer"]


def role_rank(category: Column, roles: list[str]) -> Column:
    """Position of a category in a priority list; categories outside it come last."""
    listed = F.array_position(F.array(*map(F.lit, roles)), category)
    return F.when(listed > 0, listed).otherwise(len(roles) + 1).cast("int")
