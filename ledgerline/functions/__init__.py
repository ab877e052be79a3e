"""Column expression helpers; every function takes and returns Columns."""
