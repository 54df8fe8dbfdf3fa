"""Three-source record reconciliation on Spark DataFrames."""
