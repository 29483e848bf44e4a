"""All registered queries of the engine with the SQL that checks them."""

from __future__ import annotations

from .plans import answering, finding, governing, ingesting, knowing, living, measuring, processing, remembering, retrieval, streams

MODULES = (retrieval, governing, remembering, living, answering, measuring, processing, ingesting, knowing, streams, finding)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
