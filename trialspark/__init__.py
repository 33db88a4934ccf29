"""Trial evaluation, dataset auditing and training-data preparation on Spark DataFrames."""
