"""Operators over run telemetry, evidence and documents: DataFrames in, DataFrames out."""
