"""Operators of a training-data pipeline: search, near duplicates, quality, tokens, packing.

Nothing outside this package and ``corpus_pipeline.py`` imports it.  Every
operator takes DataFrames and column names and returns a DataFrame; the thin
``opN_*`` queries in ``queries.py`` fix the tables and parameters.
"""
