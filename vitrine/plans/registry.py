"""All queries of the engine and their SQL."""

from __future__ import annotations

from vitrine.plans import analytics, audits, extra, files, landing, merge, more, names, ranking, state, stores

PARTS = [analytics, ranking, state, more, extra, names, stores, merge, audits, files, landing]


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}
