"""Operators that prepare crawled text as training data."""
