"""The registered queries, with their SQL for DuckDB."""
