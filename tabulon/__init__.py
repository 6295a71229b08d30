"""A tabular analytics library on Spark DataFrames."""
