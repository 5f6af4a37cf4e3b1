"""Column functions: names, sequences, intervals."""
