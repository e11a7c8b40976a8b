"""Operators for preparing training text, on Spark DataFrames.

Nothing else in ``outways`` imports this subpackage.
"""
