"""Training-data operators: chat formatting, tokenising, filtering, deduplication, sharding, search and mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
