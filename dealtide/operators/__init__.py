"""The operators. Each takes and returns DataFrames; constants are keyword parameters."""
