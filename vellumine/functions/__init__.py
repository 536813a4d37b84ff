"""Functions of the dialect whose meaning differs from Spark's, or that Spark lacks, as Column helpers."""
