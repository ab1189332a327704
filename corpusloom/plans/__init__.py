"""Queries over the supplied tables; `queries.QUERIES` and `queries.SQL` hold those of all modules here."""

from . import files, queries  # noqa: F401
