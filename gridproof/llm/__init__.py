"""Training-data operators: quality rules, near-duplicates, language ID, tokenizing, packing, chat formatting.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
