"""Column functions for codes, dates, nulls and arrays."""
