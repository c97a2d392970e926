"""Environment-variable analytics over code corpora, on Spark DataFrames."""
