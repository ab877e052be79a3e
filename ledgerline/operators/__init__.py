"""Analytics operators: DataFrames in, DataFrames out, no actions inside."""
