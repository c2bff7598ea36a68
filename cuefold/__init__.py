"""Caption, candidate and publishing analytics on Spark DataFrames."""
