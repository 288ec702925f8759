"""Operators over DataFrames of samples, events, bins, edges and fields."""
