"""Queries over the bound tables, each with the SQL that must give the same rows."""

from . import core, documents, flagship, misc, more, review, spatial, stateful, streams
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "core", "documents", "flagship", "misc", "more", "review", "spatial", "stateful", "streams"]
