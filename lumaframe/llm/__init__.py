"""Operators that prepare data for training; nothing outside this package imports it."""
