"""Named queries on the tables at hand, by family, with the SQL that says the same."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("timeline", "totals", "words", "places", "machines", "tracks", "motion", "roads", "parsing", "signals", "spots", "drives", "bus", "pilots")


def all_queries() -> dict:
    return {k: v for f in FAMILIES for k, v in import_module(f"{__name__}.{f}").QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for f in FAMILIES for k, v in import_module(f"{__name__}.{f}").ORACLES.items()}
