"""Corpus analytics on PySpark: evidence-grade document corpora as DataFrames."""
