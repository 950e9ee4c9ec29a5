"""Column functions: built-in expressions only, so they stay inside generated code."""
