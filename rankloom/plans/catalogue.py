"""All registered queries."""

from __future__ import annotations

from rankloom.plans import columns, files, recipes, runs, streams, tables  # noqa: F401  (importing registers)
from rankloom.plans.registry import CHECKS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
