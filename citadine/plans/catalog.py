"""Every query of the library by name, with its equivalent in DuckDB's SQL where there is one."""

from __future__ import annotations

from citadine.plans import chain, contrasts, exploring, features, ingest, network, payloads, regions, registry  # noqa: F401  they register their queries
from citadine.session import ready


def queries():
    return {name: (lambda spark, d, f=f: f(ready(spark), d)) for name, f in registry.QUERIES.items()}


def oracle_sql():
    return dict(registry.ORACLES)
