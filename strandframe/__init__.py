"""Protein-structure and sequence-design tables, and training-data operators, on Spark DataFrames."""
