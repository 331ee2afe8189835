"""titlelake: catalogue analytics for film, television and people data on PySpark."""

from titlelake.catalog import Catalog

__all__ = ["Catalog"]
