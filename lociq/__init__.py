"""Population-scan analytics on Spark DataFrames."""
