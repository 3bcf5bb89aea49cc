"""Company-similarity analytics on Spark DataFrames."""
