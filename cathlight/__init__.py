"""Cathlight: curation, retrieval and evaluation of clinical-archive tables on PySpark."""

__version__ = "0.1.0"
