"""Brindle: recommendation-corpus and training-data analytics on PySpark DataFrames."""
