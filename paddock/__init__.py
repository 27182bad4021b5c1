"""Racing-league analytics on Spark DataFrames."""
