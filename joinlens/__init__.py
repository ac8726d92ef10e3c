"""Join-size estimation and probabilistic analytics on Spark DataFrames."""
