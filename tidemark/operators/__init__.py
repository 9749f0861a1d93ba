"""Operators on time series held in DataFrames."""
