"""Operators on DataFrames: search, rules, calibration, model building."""
