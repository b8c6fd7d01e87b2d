"""Clean daily stock bars at scale with Spark DataFrames."""
