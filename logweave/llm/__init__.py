"""Operators of a training-data pipeline on DataFrames.  Nothing else in the library imports this subpackage."""
