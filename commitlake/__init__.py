"""Versioned-repository analytics on PySpark."""
