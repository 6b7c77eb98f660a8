"""Operators and queries for preparing language-model training text.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
