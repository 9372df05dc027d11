"""Operators that prepare chat collections as training data. Nothing else in the package imports this."""
