"""All modules that register queries."""

from . import catalogue, filters, linking, matches, mutations, scenes, shapes, splats, trees, usage, views  # noqa: F401

QUERIES = catalogue.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL
