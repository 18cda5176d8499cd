"""Sequence-specificity analytics on Spark DataFrames."""
