"""All queries of the library on the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from quarrystone.plans import builds, cells, customers, documents, graphs, property_graph, records, results, retrieval, workflows
from quarrystone.plans.registry import ORACLES, QUERIES

FLAGSHIP = "panorama_sections"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "builds", "cells", "customers", "documents", "graphs", "property_graph", "records", "results", "retrieval", "workflows"]
