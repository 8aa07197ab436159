"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Every operator takes
DataFrames, reads only the columns it names, and returns a DataFrame with a fixed set of
columns, so extra input columns (whatever their names) neither clash nor pass through.
"""
