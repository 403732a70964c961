"""Siltstone: retrieval, repository analytics and corpus operators as PySpark DataFrame functions."""
