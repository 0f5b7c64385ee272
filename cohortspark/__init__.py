"""Cohort auditing, prediction evaluation and corpus preparation on Spark DataFrames."""
