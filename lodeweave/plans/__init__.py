"""Registered queries, one module for each part of the operator inventory."""
from . import codegraph, entities, filters, graphs, ingest, monitoring, relational, search, store, streams  # noqa: F401
