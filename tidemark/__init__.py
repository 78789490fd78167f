"""tidemark: point-in-time tick analytics on Spark DataFrames."""
