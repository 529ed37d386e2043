"""All registered queries of this subpackage: name to callable, and DuckDB SQL where it can express one."""

from __future__ import annotations

from . import queries_native, queries_python

QUERIES = {**queries_native.QUERIES, **queries_python.QUERIES}
ORACLE_SQL = {**queries_native.ORACLE_SQL, **queries_python.ORACLE_SQL}
