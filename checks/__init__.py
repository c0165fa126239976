"""DuckDB statements that state each query's result on their own terms."""
