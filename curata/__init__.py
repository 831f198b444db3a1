"""Catalogue curation and evidence operators on Spark DataFrames."""
