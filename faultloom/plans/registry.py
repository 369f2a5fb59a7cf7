"""All queries of the library by name, and their DuckDB counterparts."""

from . import code_queries, fact_queries, file_queries, real_queries, text_queries, trace_queries

MODULES = (trace_queries, fact_queries, text_queries, code_queries, file_queries, real_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
