"""All registered queries and their expected results in plain SQL."""

from __future__ import annotations

from fleet_audit.plans import config_audit, query_audit, store_audit

_MODULES = (config_audit, query_audit, store_audit)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
