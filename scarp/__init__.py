"""Structure-response landscapes on Spark DataFrames.

The package takes a table of items, each with a vector and a measured response,
builds the pair table and answers where near neighbours disagree.
"""
