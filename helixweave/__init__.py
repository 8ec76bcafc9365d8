"""Mapping sequences and sampled signals onto path-annotated graphs, as Spark DataFrames."""
