"""Operators for preparing training data: dedup, redaction, tokenising, filtering, mixing, sharding and search.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; the order-book engine works without it.
"""
