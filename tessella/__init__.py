"""Tessella: retrieval, evaluation and test-intelligence analytics on PySpark."""
