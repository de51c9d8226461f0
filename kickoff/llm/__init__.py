"""Training-data operators (token counts, deduplication, mixing, search, scoring, filtering, scans, BPE).

Nothing else in the package imports this one. Each operator is a module with its own docstring;
``queries.py`` registers the ``opN_*`` queries and ``SQL`` the DuckDB statements that check them.
"""
