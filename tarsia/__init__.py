"""Supervision analytics over security-operations records, as plain functions on Spark DataFrames."""
