"""A key-value analytics engine on Spark DataFrames."""
