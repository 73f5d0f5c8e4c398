"""Training-data operators: each module is one operator with its own general interface.

``queries.py`` holds the thin registered queries. Nothing outside this folder
imports it except ``__spark_entry__.py`` (guarded) and ``corpus_pipeline.py``.
"""
