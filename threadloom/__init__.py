"""Fact-graph analytics on Spark: files, nodes, edges, operations, searches, spans and workflows as DataFrames."""
