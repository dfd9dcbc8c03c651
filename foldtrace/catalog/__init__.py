"""Registered queries and their DuckDB counterparts."""

from importlib import import_module

GROUPS = ("folded", "normalized", "relational", "ingest", "stateful", "programs")


def all_queries() -> dict:
    merged: dict = {}
    for group in GROUPS:
        merged.update(import_module(f"{__name__}.{group}").QUERIES)
    return merged


def all_oracles() -> dict[str, str]:
    merged: dict[str, str] = {}
    for group in GROUPS:
        merged.update(import_module(f"{__name__}.{group}").ORACLE)
    return merged
