"""DuckDB oracle: independent SQL statements of every named query."""
