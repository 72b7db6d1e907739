"""All registered queries of the core, and their SQL twins where SQL can express them."""

from __future__ import annotations

from locusweave.plans import numbered, reference

MODULES = [numbered, reference]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
