"""Trajectory analytics and data-quality checks on Spark DataFrames."""
