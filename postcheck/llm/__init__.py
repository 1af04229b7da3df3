"""Training-data pipeline operators: tokenising, dedup, mixing, scoring and search over Spark DataFrames."""
