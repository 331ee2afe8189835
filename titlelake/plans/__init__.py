"""The named queries: browsing, analysis, nested documents, payloads."""
