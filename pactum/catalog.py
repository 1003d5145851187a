"""Every registered query of the contract and snapshot engine, with its oracle SQL."""

from __future__ import annotations

from .queries import contracts, derivations, merges, routines, snapshots

MODULES = (snapshots, merges, contracts, derivations, routines)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
