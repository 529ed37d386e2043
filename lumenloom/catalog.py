"""Registered queries over the driver tables and their DuckDB SQL."""

from .plans import corpus_queries, eval_queries, storage_queries, stream_queries

_MODULES = (corpus_queries, eval_queries, storage_queries, stream_queries)
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
