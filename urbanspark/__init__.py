"""Urban mobility analytics on Spark DataFrames."""
