"""Column functions, SQL functions and table functions."""
