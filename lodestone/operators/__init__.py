"""The index and the operators that search it."""
