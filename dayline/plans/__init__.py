"""Queries over the tables of a folder; catalog() has them all."""

from __future__ import annotations


def catalog():
    """(queries by name, SQL by name)."""
    from . import fixtures, records, relational, streams, textual  # noqa: F401
    from .registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
