"""Operators for training-data pipelines, their queries and the SQL that checks them.

Nothing outside this folder imports it, apart from the entry file and ``corpus_pipeline``.
"""
