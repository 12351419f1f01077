"""Contraction paths, their cost, and the lowering to DataFrames."""
