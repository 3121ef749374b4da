"""Corpus retrieval, evaluation and training-data operators as Spark plans."""
