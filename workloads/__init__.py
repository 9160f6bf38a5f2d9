"""The registered queries and their SQL counterparts."""

from . import branches, files, grids, profiles, schemas, streams, tables  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
