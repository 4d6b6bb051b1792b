"""Measuring and segmenting ordered numeric series with DataFrames."""
