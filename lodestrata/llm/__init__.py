"""Training-data operators: one module for each, plus the queries and SQL that apply them.

Nothing outside this package, its tests and ``corpus_pipeline.py`` imports it.
"""
