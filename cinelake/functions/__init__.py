"""Scalar functions as column builders; Arrow UDFs only where Spark has none."""
