"""Vellumine: an analytics engine written against the PySpark DataFrame and SQL APIs."""
