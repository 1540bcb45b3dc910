"""Queries by kind, each with SQL where SQL can say the same."""

from quirespark.plans import aggregates, chapters, core_problems, documents, images, packages, reports, scalars

_MODULES = (core_problems, scalars, aggregates, documents, packages, chapters, images, reports)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
