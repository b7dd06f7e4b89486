"""The registered queries and the SQL that each is checked against."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> function of session and folder) and ORACLES (name -> SQL).
MODULES: tuple[str, ...] = ("recollect.queries.documents", "recollect.queries.facts", "recollect.queries.vectors", "recollect.queries.graph")


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(name), attribute)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLES")
