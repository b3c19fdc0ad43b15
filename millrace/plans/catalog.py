"""Every registered query and the SQL that states its result."""

from __future__ import annotations

from . import ledger, models, planning, plant, purchasing, quality, reconcile, registers, relations, reports, sales, shopfloor, streams, supply

MODULES = [planning, models, supply, reports, purchasing, sales, shopfloor, plant, ledger, reconcile, quality, relations, registers, streams]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP = "p04_time_phased_atp"
