"""Research-paper analytics on Spark DataFrames."""
