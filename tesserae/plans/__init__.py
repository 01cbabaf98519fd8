"""Query registry, reference SQL and session helpers."""
