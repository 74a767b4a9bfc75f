"""The engine's query catalogue."""

from __future__ import annotations

from maskwright.catalog import Catalog
from maskwright.plans import detection, entity_queries, other_queries, service_queries, sink_queries, state_queries

CATALOG = Catalog()
for module in (detection, entity_queries, other_queries, service_queries, state_queries, sink_queries):
    module.register(CATALOG)
