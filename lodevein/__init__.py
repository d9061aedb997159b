"""Attributed-graph pattern analytics and tabular subgroup discovery on Spark DataFrames."""
