"""Civic demand analytics on Spark: reports, registers, scores, clusters and money as DataFrames."""
