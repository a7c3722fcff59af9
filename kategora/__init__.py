"""Document categorisation on Spark DataFrames."""
