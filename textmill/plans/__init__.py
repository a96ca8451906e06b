"""Analyses, reports, and the registered queries with their oracles."""
