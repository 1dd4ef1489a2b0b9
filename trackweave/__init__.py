"""Track forests and candidate-link analytics on Spark DataFrames."""
