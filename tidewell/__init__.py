"""Search-and-discovery analytics on Spark DataFrames."""
