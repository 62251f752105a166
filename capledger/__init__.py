"""Regulatory-capital analytics on PySpark DataFrames."""
