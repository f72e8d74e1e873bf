"""Queries and SQL of the fact-graph operators."""

from __future__ import annotations

from threadloom.catalog import QUERIES, SQL
from threadloom.operators import components, correlate, documents, evidence, execution, flows, graph, ignore, inventory, navigation, overview, project, redaction, references, runtime, search, structure, triangles, views
from threadloom.operators import spans as span_edges
from threadloom.sources import protocols
from threadloom.streaming import sessions, spans

__all__ = ["QUERIES", "SQL", "components", "correlate", "documents", "evidence", "execution", "flows", "graph", "ignore", "inventory", "navigation", "overview", "project", "protocols", "redaction", "references", "runtime", "search", "sessions", "span_edges", "spans", "structure", "triangles", "views"]
