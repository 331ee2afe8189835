"""The catalogue: eight named tables, each opened on first use."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from titlelake.schemas import TABLES


class Catalog:
    """Tables by name, as items (``cat["title"]``) or attributes (``cat.title``).

    ``opener`` maps a table name to its DataFrame and is called once per table, so a
    query plans only the tables it names. ``copies`` finds copies by table and column, and ``ranged`` has tables that
    come in ranges of their first columns at the cost of one shuffle. ``counted`` has rows with a derived table's keys that cost
    less to read than the table, to find its frequent keys.
    """

    def __init__(
        self,
        opener: Callable[[str], DataFrame],
        copies: Callable[[str, str], DataFrame | None] | None = None,
        ranged: Mapping[str, Callable[[], DataFrame]] | None = None,
        counted: Mapping[str, Callable[[], DataFrame]] | None = None,
    ):
        self._opener = opener
        self._copies = copies
        self._ranged = ranged or {}
        self._counted = counted or {}
        self._open: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame]) -> Catalog:
        return cls(dict(tables).__getitem__)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(f"no catalogue table named {name!r}")
        if name not in self._open:
            self._open[name] = self._opener(name)
        return self._open[name]

    def clustered(self, name: str, column: str) -> DataFrame:
        """A table for lookups by a column: its copy that is sorted by it, if the catalogue has one."""
        copy = self._copies(name, column) if self._copies else None
        return self[name] if copy is None else copy

    def ranged(self, name: str, order: list[str]) -> DataFrame:
        """A table in ranges of ``order``; a table that can be derived in ranges of its first columns isn't moved again."""
        return self._ranged[name]() if name in self._ranged else self[name].repartitionByRange(*order)

    def to_count(self, name: str) -> DataFrame:
        """Rows in which the frequent keys of a table are about as frequent: those it is derived from, or its own."""
        return self._counted[name]() if name in self._counted else self[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as missing:
            raise AttributeError(str(missing)) from None

    def replace(self, **tables: DataFrame) -> Catalog:
        """The same catalogue with some tables exchanged."""
        return Catalog(lambda name: tables[name] if name in tables else self[name])
