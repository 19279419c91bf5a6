"""Corpus-scale text translation analytics on Spark DataFrames."""
