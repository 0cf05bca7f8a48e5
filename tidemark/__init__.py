"""Point-in-time market panels on Spark DataFrames."""
