"""Tensor operators on DataFrames."""
