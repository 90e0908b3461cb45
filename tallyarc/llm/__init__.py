"""Operators for preparing training data, each a DataFrame-to-DataFrame function."""
