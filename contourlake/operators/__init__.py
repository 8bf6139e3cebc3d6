"""Operators: functions from DataFrames to DataFrames. Column roles are arguments; defaults are token, time, f0, speaker, tone."""
