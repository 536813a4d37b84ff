"""Relational operators that Spark SQL has no syntax for, as DataFrame functions."""
