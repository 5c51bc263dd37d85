"""Training-data operators: one module per operator, queries and SQL in ``queries``.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
