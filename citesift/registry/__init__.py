"""Registered queries on the test tables, each with its SQL twin where one exists."""

from citesift.registry import export, features, metrics, modelling, retrieval, text

_SECTIONS = (retrieval, text, features, modelling, metrics, export)

QUERIES = {name: fn for section in _SECTIONS for name, fn in section.QUERIES.items()}
ORACLE = {name: sql for section in _SECTIONS for name, sql in section.ORACLE.items()}
