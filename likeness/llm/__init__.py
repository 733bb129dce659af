"""Operators for preparing training data, each a function on DataFrames.

Nothing outside this package imports it; ``queries`` holds what
``__spark_entry__`` registers.
"""
