"""Operators: plain functions from DataFrames to a DataFrame."""
