"""Text privacy analytics on Spark DataFrames."""
