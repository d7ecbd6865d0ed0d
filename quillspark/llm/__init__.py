"""Operators for training-corpus preparation.

Nothing outside this subpackage (bar ``__spark_entry__.py`` and
``corpus_pipeline.py``) imports it.
"""
