"""Sylva: a file-catalog search and analytics engine on PySpark."""
