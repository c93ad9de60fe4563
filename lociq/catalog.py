"""All registered queries of the interval and motif engine, and their SQL."""

from __future__ import annotations

from .plans import aggregates, files, intervals, sequences, streams

MODULES = [intervals, aggregates, sequences, files, streams]
QUERIES = {name: f for module in MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
