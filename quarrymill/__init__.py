"""Batch retrieval, verification and evaluation of answers as Spark DataFrame plans."""
