"""Independent DuckDB statements for the registered queries."""
