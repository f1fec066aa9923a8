"""Graph clustering and supervised learning on Spark DataFrames."""
