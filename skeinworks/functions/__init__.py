"""Fixed values and small column functions."""
