"""Queries by name, each with DuckDB SQL for the same rows where SQL can express it."""

from quarry.plans import glossary_queries, job_queries, layout_queries, record_queries, state_queries, stream_queries, text_queries

_MODULES = (text_queries, job_queries, glossary_queries, layout_queries, record_queries, state_queries, stream_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
