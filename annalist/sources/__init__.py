"""Reading and writing the history tables."""
