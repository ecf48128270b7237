"""Loamline: mining software-evolution evidence with Spark DataFrames."""
