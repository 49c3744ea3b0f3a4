"""Declarative recipes and the DataFrames they stand for."""
