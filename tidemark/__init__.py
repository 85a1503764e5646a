"""Frame-in, frame-out analytics on Spark DataFrames."""
