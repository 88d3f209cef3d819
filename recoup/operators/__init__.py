"""Operators: DataFrames in, DataFrames (or small fitted summaries) out."""
