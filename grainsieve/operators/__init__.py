"""Operators: functions from DataFrames to DataFrames, built from expressions of the JVM."""
