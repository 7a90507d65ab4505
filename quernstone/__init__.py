"""Quernstone: description-length and data-quality analytics on Spark DataFrames."""
