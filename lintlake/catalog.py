"""All queries of the library but those of the training-data subpackage, and their SQL."""

from __future__ import annotations

from lintlake.plans import bodies, callmap, code, contracts, corpus, elements, flows, rules, texts, upkeep, warehouse

_PLANS = (bodies, callmap, code, contracts, corpus, elements, flows, rules, texts, upkeep, warehouse)


def queries() -> dict:
    return {n: f for p in _PLANS for n, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q for p in _PLANS for n, q in p.SQL.items()}
