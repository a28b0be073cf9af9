"""Operators for training-data pipelines. Nothing outside this folder, corpus_pipeline.py and the tests imports it."""
