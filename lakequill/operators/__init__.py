"""Operators on DataFrames that the dialect needs beside Spark's own."""
