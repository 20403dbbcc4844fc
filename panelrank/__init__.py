"""Panel preparation, leakage-safe features and grouped ranking on Spark DataFrames."""
