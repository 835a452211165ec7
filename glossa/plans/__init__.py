"""Registered queries over the driver's tables. Importing a module of this folder registers its queries."""

from . import collections, discs, presentation, searches, streams, words
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "collections", "discs", "presentation", "searches", "streams", "words"]
