"""All registered queries and their checking SQL."""

from __future__ import annotations

from shelfcast.plans import demand, inventory, learning, planning, statistics, streaming
from shelfcast.plans.base import Query

MODULES = (inventory, statistics, demand, planning, learning, streaming)


def queries() -> dict[str, Query]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLES.items()}
