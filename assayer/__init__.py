"""Query-evaluation analytics on Spark DataFrames."""
