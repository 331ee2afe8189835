"""The queries of the correctness check and their DuckDB counterparts."""
