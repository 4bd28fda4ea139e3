"""Column expressions with the numeric and text rules of the reports."""
