"""Registered queries by area."""

from . import graph, html, ingest, relational, retrieval, text
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "graph", "html", "ingest", "relational", "retrieval", "text"]
