"""Batch jobs over security findings of many repositories, as Spark DataFrames."""
