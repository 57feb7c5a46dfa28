"""Column functions: everything here is an expression of built-in functions."""
