"""Training-data operators over document, page and vector tables.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
