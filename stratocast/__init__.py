"""Point-in-time time-series analytics on Spark DataFrames and streams."""
